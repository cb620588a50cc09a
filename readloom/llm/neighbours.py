"""Fingerprints of documents and of their edited texts, in the order of doc_id.

The edited text of a document takes its end from the next document's start, so documents are dealt to ranges of
(doc_id, a hash of the text, a hash of the row's place) and streamed in order; the first document of a range is also
sent to the range before, as the neighbour of its last one. Nothing else crosses ranges. The boundaries are sampled
by size, each range is a task of its own, and however many rows share a doc_id, or are equal, they are divided like
others. Results do not depend on the boundaries.

Defined results: null texts are empty; null doc_ids come first; rows with one doc_id are ordered by their text's
hash; equal rows follow each other; the last document is followed by the first one, a single one by itself; an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import common, fingerprints
from readloom.llm.sharding import search

#: Bytes of text of a range, and sampled keys for each.
RANGE_BYTES, SAMPLES = 16 << 20, 8
#: The most ranges, and so boundaries that the driver sends along (some 5 MB); beyond, ranges are longer, and still streamed.
MOST_RANGES = 200_000

_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _place(cuts: np.ndarray):
    """The range of a key of three parts: how many boundaries it has reached."""

    def place(k1: pa.Array, k2: pa.Array, k3: pa.Array) -> pa.Array:
        keys = np.empty(len(k1), cuts.dtype)
        for name, column in zip("abc", (k1, k2, k3), strict=True):
            keys[name] = column.to_numpy(zero_copy_only=False)
        return pa.array(search(cuts, keys), pa.int64())

    return place


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _stream(samples: int):
    kind = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def rows(chunk: list[tuple], k: int) -> pa.RecordBatch:
        """chunk: documents in order, the last one only as a neighbour."""
        texts = [t for _, t, _ in chunk]
        cut = [edited(t, f) for t, f in zip(texts[:-1], texts[1:], strict=True)]
        own = fingerprints.signatures(common.Texts(texts), k)
        other = fingerprints.signatures(common.Texts(cut), k)
        hexes = fingerprints.to_hex(own)
        columns = [
            [i for i, _, _ in chunk[:-1]], [len(t) for t in texts[:-1]], [hashlib.sha256(t.encode()).hexdigest() for t in cut], hexes[:-1], fingerprints.to_hex(other),
            fingerprints.likeness(own[:-1], other).tolist(), fingerprints.likeness(own[:-1], own[1:]).tolist(),
        ]
        keep = [not helper for _, _, helper in chunk[:-1]]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind).filter(pa.array(keep, pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: list[tuple] = []
        region, size = None, 0
        for batch in common.slices(batches, "text"):
            for where, name, text, helper in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if where != region:
                    if len(chunk) > 1:
                        yield rows(chunk, samples)
                    chunk, region, size = [], where, 0
                chunk.append((name, text, helper))
                size += len(text)
                if size > common.CHUNK_BYTES and len(chunk) > 1:
                    yield rows(chunk, samples)
                    chunk, size = chunk[-1:], len(text)
        if len(chunk) > 1:
            yield rows(chunk, samples)

    return run


def fingerprint_neighbours(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", samples: int = fingerprints.SAMPLES) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), body.alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k1"), F.xxhash64("text").alias("k2"), F.xxhash64(F.monotonically_increasing_id()).alias("k3")
    )
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(min(MOST_RANGES, max(1, -(-size // RANGE_BYTES))))
    cuts: list[tuple[int, int, int]] = []
    if ranges > 1:
        # a draw in [0, 1); a text longer than a range's share of a sample is always drawn
        draw = F.pmod(F.xxhash64("k1", "k2", "k3", F.lit(5)), F.lit(1 << 53)).cast("double") / float(1 << 53)
        chance = F.octet_length("text") * F.lit(SAMPLES * ranges / size)
        drawn = narrow.where(draw < chance).select("k1", "k2", "k3", F.greatest(F.lit(1), F.round(chance)).cast("int").alias("times")).collect()
        keys = sorted((r["k1"], r["k2"], r["k3"]) for r in drawn for _ in range(r["times"]))
        cuts = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
    boundaries = np.array(cuts, dtype=[("a", "i8"), ("b", "i8"), ("c", "i8")])
    located = narrow.withColumn("region", F.arrow_udf(_place(boundaries), "long")("k1", "k2", "k3"))
    # the first document of each range goes also to the range before, that of the first range to the last
    keys = F.struct("k1", "k2", "k3")
    firsts = {r["region"]: r["first"] for r in located.groupBy("region").agg(F.min(keys).alias("first")).collect()}
    order = sorted(firsts)
    sent = [(*firsts[r][:2], r, order[i - 1]) for i, r in enumerate(order)]
    sent = F.broadcast(common.small_table(docs.sparkSession, sent, "k1 long, k2 long, region long, before long"))
    helpers = located.join(sent, ["k1", "k2", "region"]).groupBy("before").agg(F.min_by(F.struct("doc_id", "text", "k1", "k2", "k3"), "k3").alias("d"))
    helpers = helpers.select(F.col("before").alias("region"), F.lit(True).alias("helper"), "d.*")
    rows = located.select("region", F.lit(False).alias("helper"), "doc_id", "text", "k1", "k2", "k3").unionByName(helpers)
    dealt = rows.repartitionById(len(cuts) + 1, F.col("region").cast("int")).sortWithinPartitions("region", "helper", "k1", "k2", "k3")
    return dealt.select("region", "doc_id", "text", "helper").mapInArrow(common.freed(_stream(samples)), _SCHEMA)
