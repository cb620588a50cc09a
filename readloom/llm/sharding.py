"""Sharding by sampled splitters.

Records are ordered by (hash of the text, doc_id, a hash of the row), so that equal texts are neighbours. A
size-weighted sample of these keys gives quantile boundaries of many narrow ranges; each record goes to its
range by binary search; exact sizes of the ranges are counted, and a range that holds far more than its share is
sampled anew and subdivided until none does or what is left over is a single record. Ranges are then dealt to shards in order, each to the shard in
which the middle of its bytes falls. Equal texts share a shard unless a boundary has to fall between
them: a group of copies that holds a third of all rows is divided by doc_id.

What the driver sees grows with the number of ranges only, which is a parameter. Slots are the range's offset
in its shard plus the rank within the range, so no task holds a whole shard.

Defined results: null texts have no bytes and size 1; repeated rows keep each its own slot; an empty table
gives no rows; ties are broken by the row's place; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm import common

#: Ranges for each shard. A shard's size is off by one range at most.
RANGES = 64
#: Sampled keys for each range.
SAMPLES = 48
#: A range is overfull beyond so many times its share.
OVERFULL = 2.0

def _with_ranges(keyed: DataFrame, splitters: list[tuple[int, int, int]]) -> DataFrame:
    """Add `range`: how many splitters are not above the record's key. splitters are sorted and bounded by the parameters."""
    cuts = np.array(splitters, dtype=[("a", "i8"), ("b", "i8"), ("c", "i8")])

    def run(batches):
        for batch in batches:
            keys = np.empty(batch.num_rows, cuts.dtype)
            for name, column in zip("abc", ("k1", "k2", "k3"), strict=True):
                keys[name] = batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
            place = search(cuts, keys)
            yield batch.append_column("range", pa.array(place, pa.int64()))

    return keyed.mapInArrow(common.freed(run), T.StructType([*keyed.schema.fields, T.StructField("range", T.LongType())]))


def search(cuts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Binary search of three-part keys, all at once."""
    low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(cuts), np.int64)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        c = cuts[np.minimum(mid, len(cuts) - 1)]
        below = (c["a"] < keys["a"]) | (c["a"] == keys["a"]) & ((c["b"] < keys["b"]) | (c["b"] == keys["b"]) & (c["c"] <= keys["c"]))
        low, high = np.where(open_ & below, mid + 1, low), np.where(open_ & ~below, mid, high)
    return low


def _sample(ranged: DataFrame, shares: dict[int, float], total: float) -> dict[int, list[tuple[int, int, int]]]:
    """Size-weighted keys of the named ranges: a record of b bytes is drawn with chance SAMPLES * parts * b / bytes of its range, by a hash of its key. shares: bytes of each range."""
    rate = F.element_at(F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, SAMPLES * max(2.0, v / total) / v)]), F.col("range"))
    # a draw in [0, 1); a record larger than 1 / rate is always drawn
    draw = F.pmod(F.xxhash64("k1", "k2", "k3", F.lit(71)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    wanted = ranged.where(F.col("range").isin(*shares)).where(draw < F.col("size") * rate)
    got: dict[int, list[tuple[int, int, int]]] = {k: [] for k in shares}
    for row in wanted.groupBy("range", "k1", "k2", "k3").agg(F.sum("size").alias("size")).collect():
        # a heavy key stands for as many samples as its size calls for
        times = max(1, round(row["size"] * SAMPLES * max(2.0, shares[row["range"]] / total) / shares[row["range"]]))
        got[row["range"]] += [(row["k1"], row["k2"], row["k3"])] * times
    return {k: sorted(v) for k, v in got.items()}


#: Below every doc_id and row hash: where the records of a text begin.
_LOWEST = -(1 << 63)


def _quantiles(sample: list[tuple[int, int, int]], parts: int) -> list[tuple[int, int, int]]:
    """Boundaries at quantiles of the sample, moved to where a text begins; within a text only if the sample holds no other. If all fall into the first text, all others are parted from it at once."""
    if not sample:
        return []
    cuts = [sample[len(sample) * i // parts] for i in range(1, parts)]
    if sample[0][0] != sample[-1][0]:
        cuts = [(k, _LOWEST, _LOWEST) for k, _, _ in cuts if k != sample[0][0]] or [(next(k for k, _, _ in sample if k != sample[0][0]), _LOWEST, _LOWEST)]
    return cuts


def shards(docs: DataFrame, n: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per record: doc_id, size (UTF-8 bytes + 1), text_crc32, range, shard (0 to n-1) and slot (from 0 in each shard, without gaps)."""
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    keyed = docs.select(
        docs[doc_id].alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body, docs[text].isNull()).alias("k1"),
        F.coalesce(docs[doc_id].cast("long"), F.lit(-(1 << 63))).alias("k2"),
        # rows with one doc_id and text differ by where they stand, so that no group of them is indivisible
        F.xxhash64(F.monotonically_increasing_id()).alias("k3"),
    )
    keyed = common.steady(keyed)
    total = keyed.agg(F.sum("size")).first()[0] or 0
    share = max(1.0, total / (n * RANGES))
    splitters: list[tuple[int, int, int]] = []
    ranged = keyed.withColumn("range", F.lit(0).cast("long"))
    sizes: dict[int, int] = {0: total} if total else {}
    rows: dict[int, int] = {}
    done: set[tuple] = set()
    while True:
        # a range that a sample found nothing to divide in is a record larger than its share
        begin = lambda k: splitters[k - 1] if k else None
        full = {k: float(v) for k, v in sizes.items() if v > OVERFULL * share and (begin(k), v) not in done}
        if not full:
            break
        sampled = _sample(ranged, full, share)
        cut = {k: set(_quantiles(keys, max(2, round(full[k] / share)))) - set(splitters) for k, keys in sampled.items()}
        done |= {(begin(k), sizes[k]) for k, found in cut.items() if not found}
        new = set().union(*cut.values())
        if not new:
            continue
        splitters = sorted({*splitters, *new})
        ranged = _with_ranges(keyed, splitters)
        counted = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
        sizes, rows = {r["range"]: r["bytes"] for r in counted}, {r["range"]: r["rows"] for r in counted}
    if not splitters:
        rows = {0: keyed.count()}
    shard_of, offset, before, held = {}, {}, 0, [0] * n
    for k in sorted(sizes):
        shard_of[k] = min(n - 1, int((before + sizes[k] / 2) * n / total))
        offset[k] = held[shard_of[k]]
        held[shard_of[k]] += rows[k]
        before += sizes[k]
    plan = common.small_table(docs.sparkSession, [(k, shard_of[k], offset[k]) for k in shard_of], "range long, shard int, offset long")
    rank = F.row_number().over(Window.partitionBy("range").orderBy("k1", "k2", "k3")) - 1
    out = ranged.withColumn("rank", rank).join(F.broadcast(plan), "range")
    return out.select("doc_id", "size", "text_crc32", "range", "shard", (F.col("offset") + F.col("rank")).cast("long").alias("slot"))
