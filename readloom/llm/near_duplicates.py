"""Near duplicates by DartMinHash signatures, banded joining and an exact check.

Documents are weighted sets of shingles (five words; a shorter text is one shingle), each weighing as much as it
occurs, and are similar to the degree of their generalised Jaccard similarity. The plane of weight and
rank above a shingle is divided into regions of doubling size; a hash of shingle and region throws a Poisson
number of darts into it, each with a weight, a rank and a coordinate. The darts below the shingle's weight and
under a rank bound that gives about k ln k + 2k darts a document count; the earliest dart of each coordinate is
the signature (a document with an empty coordinate looks at twice the rank, until none is empty). So a
shingle costs a few hashes and not k, and two signatures agree in a coordinate with the chance of the
documents' weighted Jaccard similarity.

Five coordinates make a band, 26 bands a document: a pair of similarity 0.8 meets with a chance above 0.9999.
Documents of equal shingle sets are one node from the start. A node is linked to the smallest node of each of
its bands, candidates are checked exactly over whole texts, and links are closed to components. In bands whose
nodes are then still of several components, counts of the shingles that occur outside a node's component, in groups
by their hash, bound from above how similar two nodes can be; pairs between components within the bound go to the
check as well. So no pair that shares a band goes unexamined unless it is of one component already or provably below the
similarity, and pairs within a group of copies are never written out.

A node is named by the smallest doc_id that has its shingles; where rows of one doc_id have different texts, so that
two nodes would have one name, these are named by a hash of their shingles, and their classes are held together.

Defined results: a null text or null doc_id is compared with nothing (class_id is doc_id); texts without a
word are of a class with equal texts only; rows with one doc_id are one document, in one class with all that any
of its texts is similar to, whatever the order of rows; an empty table gives no rows; other columns are not read,
whatever their names.

Bound of the work: n documents that are all of one band, in n components, and pairwise within the bound of grouped
counts but below the similarity, cost n^2 comparisons of counts; no signature tells such pairs from similar ones.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import common
from readloom.llm.graph import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 26, 5
#: Parts into which a node's shingles are dealt to bound what it can share with another.
GROUPS = 32
#: Width of the first band of ranks; the following double.
FIRST_RANK = 1 / 64
_UNIT = float(1 << 32)


@functools.lru_cache(256)
def _poisson(area: float) -> np.ndarray:
    """Cumulative chances of 0, 1, 2 ... darts in a region."""
    n = int(area + 12 * math.sqrt(area) + 16)
    logs = np.arange(n) * math.log(area) - area - np.cumsum(np.log(np.maximum(np.arange(n), 1)))
    return np.cumsum(np.exp(logs))


def _bands(top: float, first: float) -> list[tuple[float, float]]:
    """Bands that double in width from [0, first) to beyond top."""
    out, low, high = [], 0.0, first
    while low < top:
        out.append((low, high))
        low, high = high, high * 2
    return out


def dart_signatures(element: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """(n, k) signature of the darts of each owner's weighted elements (hashes). Owners without elements keep zeros."""
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(owner, weight, n)
    missing = total > 0
    darts_wanted = k * math.log(k) + 2 * k
    while missing.any():
        bound = np.where(missing, darts_wanted / np.maximum(total, 1e-300), 0.0)
        live = missing[owner]
        e, o, w = element[live], owner[live], weight[live]
        found: list[tuple[np.ndarray, ...]] = []
        for i, (w_low, w_high) in enumerate(_bands(float(w.max()), 1.0)):
            heavy = w > w_low
            for j, (r_low, r_high) in enumerate(_bands(float(bound[missing].max()), FIRST_RANK)):
                here = np.flatnonzero(heavy & (bound[o] > r_low))
                if not len(here):
                    continue
                seed = common.mix(e[here] ^ np.uint64(0x632BE59BD9B4E019 + 0x10001 * i + j))
                count = np.searchsorted(_poisson((w_high - w_low) * (r_high - r_low)), (seed >> np.uint64(11)) / float(1 << 53), "right")
                hit = np.flatnonzero(count)
                which = np.repeat(hit, count[hit])
                if not len(which):
                    continue
                number = np.arange(len(which)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
                with np.errstate(over="ignore"):
                    dart = common.mix(seed[which] + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
                place = common.mix(dart ^ np.uint64(0x5851F42D4C957F2D))
                rank = r_low + (dart >> np.uint64(32)) / _UNIT * (r_high - r_low)
                height = w_low + (place >> np.uint64(32)) / _UNIT * (w_high - w_low)
                at = here[which]
                good = (height < w[at]) & (rank < bound[o[at]])
                coordinate = (place[good] & np.uint64(0xFFFFFFFF)) % np.uint64(k)
                found.append((rank[good], o[at[good]] * k + coordinate.astype(np.int64), dart[good]))
        rank, key, dart = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(rank, kind="stable")[::-1]
        filled = np.zeros(n * k, bool)
        filled[key] = True
        flat = out.reshape(-1)
        flat[key[order]] = dart[order]  # the earliest is written last
        missing &= ~filled.reshape(n, k).all(1)
        darts_wanted *= 2
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) keys: one hash for the coordinates of a band and its number."""
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), 1))
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = common.mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, r : bands * rows : rows])
    return key


_SKETCH = "doc_id long, text_key long, d1 long, d2 long, bands array<long>"


def _sketcher(shingle: int, bands: int, rows: int, counted: bool):
    def run(batches):
        for batch in common.slices(batches, "text"):
            texts = common.Texts(batch.column(1))
            words = common.Words(texts)
            value, owner, count = common.unique_grams(*words.grams(shingle, short=True)[::2])
            n = len(texts)
            weight = count.astype(float) if counted else np.ones(len(value))
            keys = band_keys(dart_signatures(value, owner, weight, n, bands * rows), bands, rows).view(np.int64)
            size = np.bincount(owner, minlength=n)
            digest = np.zeros((2, n), np.int64)
            some = np.flatnonzero(size)
            if len(some):
                first = (np.cumsum(size) - size)[some]
                with np.errstate(over="ignore"):
                    tagged = value * np.uint64(2 * 1 + 1) + count.astype(np.uint64) if counted else value
                    for i, salt in enumerate((0x1234567, 0x89ABCDEF01)):
                        digest[i, some] = np.add.reduceat(common.mix(tagged ^ np.uint64(salt)), first).view(np.int64)
            for i in np.flatnonzero(size == 0):
                raw = hashlib.blake2b(texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes(), digest_size=16).digest()
                digest[:, i] = np.frombuffer(raw, np.int64)
            offsets = np.where(size > 0, bands, 0).cumsum()
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], offsets]), pa.int32()), pa.array(keys[size > 0].reshape(-1)))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(digest[0]), pa.array(digest[1]), lists], ["doc_id", "text_key", "d1", "d2", "bands"])

    return run


def _checker(shingle: int, similarity: float, counted: bool):
    """Of pairs with both texts, those whose similarity is high enough, with it."""

    def run(batches):
        for batch in common.slices(common.slices(batches, "text_a"), "text_b"):
            sides = []
            for name in ("text_a", "text_b"):
                words = common.Words(common.Texts(batch.column(batch.schema.get_field_index(name))))
                sides.append(common.unique_grams(*words.grams(shingle, short=True)[::2]))
            n = batch.num_rows
            value = np.concatenate([s[0] for s in sides])
            owner = np.concatenate([s[1] for s in sides])
            count = np.concatenate([s[2] for s in sides]) if counted else np.ones(len(value), np.int64)
            order = np.lexsort((value, owner))
            value, owner, count = value[order], owner[order], count[order]
            twice = np.flatnonzero((value[1:] == value[:-1]) & (owner[1:] == owner[:-1]))
            shared = np.bincount(owner[twice], np.minimum(count[twice], count[twice + 1]), n)
            union = np.bincount(owner, count, n) - shared
            ratio = np.where(union > 0, shared / np.maximum(union, 1), 0.0)
            good = ratio >= similarity - 1e-12
            yield pa.record_batch([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good)), pa.array(ratio[good])], ["a", "b", "similarity"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float, counted: bool) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough: (a, b, similarity). texts: (doc_id, text), one row a doc_id."""
    one, other = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(common.freed(_checker(shingle, similarity, counted)), "a long, b long, similarity double")


def _mixed(held: DataFrame, scratch: common.Scratch) -> DataFrame:
    """The rows of bands that hold nodes of several components."""
    keys = scratch.steady(held.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high").select("key"))
    return held.join(keys, "key", "left_semi")


def _sizer(shingle: int, counted: bool):
    def run(batches):
        for batch in common.slices(batches, "text"):
            value, owner, count = common.unique_grams(*common.Words(common.Texts(batch.column(1))).grams(shingle, short=True)[::2])
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array(nodes[owner], pa.int64()), pa.array(value.view(np.int64)), pa.array(count if counted else np.ones(len(count), np.int64), pa.int64())], ["node", "shingle", "weight"])

    return run


def _shareable(texts: DataFrame, classes: DataFrame, shingle: int, counted: bool, scratch: common.Scratch) -> DataFrame:
    """Of each node (node, text): n, the weight of its shingles, and that of those which a node of another class has as well, dealt to GROUPS parts s0, s1, ... by their hash. classes: (node, class)."""
    grams = scratch.table(texts.select("node", "text").mapInArrow(common.freed(_sizer(shingle, counted)), "node long, shingle long, weight long").join(classes, "node"))
    single = scratch.table(grams.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high").select("shingle"))
    part = F.pmod("shingle", F.lit(GROUPS))
    shared = grams.join(single, "shingle").groupBy("node").agg(*[F.sum(F.when(part == i, F.col("weight")).otherwise(0)).cast("int").alias(f"s{i}") for i in range(GROUPS)])
    out = scratch.table(grams.groupBy("node").agg(F.sum("weight").alias("n")).join(shared, "node", "left").fillna(0))
    scratch.drop(grams)
    return out


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, counted: bool = True) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its group) and rows (how often the document occurs). counted: weigh shingles by how often they occur; else each weighs one."""
    scratch = common.Scratch()
    steady = scratch.steady
    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    usable = narrow.where("doc_id is not null and text is not null").withColumn("text_key", F.xxhash64("text"))
    sketches = scratch.table(usable.select("doc_id", "text", "text_key").mapInArrow(common.freed(_sketcher(shingle, bands, rows, counted)), _SKETCH))
    # equal shingle sets: one node, named by the smallest doc_id and read in one of its texts
    nodes = steady(sketches.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "text_key")).alias("of")).select("d1", "d2", F.col("of.doc_id").alias("node"), "of.*"))
    member = steady(sketches.groupBy("doc_id", "d1", "d2").agg(F.count("*").alias("rows")))
    several = not member.groupBy("doc_id").count().where("count > 1").isEmpty()
    repeated = several or not member.where("rows > 1").isEmpty()
    if several:
        again = nodes.groupBy("node").agg(F.count("*").alias("times")).where("times > 1")
        nodes = nodes.join(again, "node", "left").withColumn("node", F.when(F.col("times") > 1, F.xxhash64("d1", "d2")).otherwise(F.col("node")))
        nodes = steady(nodes.select("d1", "d2", "node", "doc_id", "text_key"))
    member = steady(member.join(nodes.select("d1", "d2", "node"), ["d1", "d2"]))
    first = sketches.select("d1", "d2", "bands", "doc_id", "text_key").join(nodes, ["d1", "d2", "doc_id", "text_key"])
    first = first.dropDuplicates(["node"]) if repeated else first
    banded = scratch.table(first.select("node", F.explode("bands").alias("key")))
    met = steady(banded.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader != last").select("key", "leader"))
    met = scratch.table(banded.join(met, "key"))
    stars = steady(met.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    joined = None
    if not stars.isEmpty():
        # the texts of all candidates, fetched once
        ids = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "text_key")
        texts = usable.join(ids, ["doc_id", "text_key"]).select(F.col("node").alias("doc_id"), "text")
        texts = scratch.table(texts.dropDuplicates(["doc_id"]) if repeated else texts)
        links = steady(verified(stars, texts, shingle, similarity, counted).select("a", "b"))
        joined = components(links, scratch=scratch)
        # bands with nodes of several components: the pairs between components, but for those checked already
        held = scratch.table(met.join(joined, "node", "left").select("key", "node", F.coalesce("class", "node").alias("class")))
        held = scratch.table(_mixed(held, scratch))
        more = None if held.isEmpty() else _between(held, stars, texts, shingle, similarity, counted, scratch)
        if more is not None and not more.isEmpty():
            links = links.unionByName(more)
            joined = None if several else components(links, scratch=scratch)
    if several:
        # a doc_id with different texts is one document, and holds their classes together
        first = member.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.min("node").alias("first")).where("nodes > 1").select("doc_id", "first")
        same = member.join(first, "doc_id").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
        joined = components(same if stars.isEmpty() else links.unionByName(same), scratch=scratch)
    classed = member if joined is None else member.join(steady(joined), "node", "left")
    documents = classed.select("doc_id", "rows", (F.col("node") if joined is None else F.coalesce("class", "node")).alias("class_id"))
    documents = documents.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("rows").alias("rows"))
    if several:
        # classes were named by nodes, some of them by a hash
        documents = steady(documents)
        names = documents.groupBy("class_id").agg(F.min("doc_id").alias("name"))
        documents = documents.join(names, "class_id").select("doc_id", F.col("name").alias("class_id"), "rows")
    alone = narrow.where("doc_id is null or text is null").groupBy("doc_id").agg(F.count("*").alias("rows"))
    alone = alone.join(member.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("class_id"), "rows")
    return scratch.result(documents.unionByName(alone))


def _between(held: DataFrame, stars: DataFrame, texts: DataFrame, shingle: int, similarity: float, counted: bool, scratch: common.Scratch) -> DataFrame:
    """Links between nodes of different components that share a band. held: (key, node, class) of the bands that hold several components; stars: the pairs that were checked."""
    steady = scratch.steady
    open_texts = scratch.table(texts.withColumnRenamed("doc_id", "node").join(held.select("node").distinct(), "node", "left_semi"))
    shared = _shareable(open_texts, held.select("node", "class").distinct(), shingle, counted, scratch)
    scratch.drop(open_texts)
    held = scratch.table(held.join(shared, "node"))
    # what two nodes of different components share is at most the smaller part of each group; most nodes have no partner within the bound
    parts = [f"s{i}" for i in range(GROUPS)]
    all_shared = sum((F.col(c) for c in parts), F.lit(0))
    least = steady(held.groupBy("key").agg(F.min("n").alias("smallest")))
    most = all_shared >= F.lit(similarity - 1e-9) * (F.col("n") + F.greatest(F.col("smallest"), all_shared) - all_shared)
    held = scratch.table(_mixed(held.join(least, "key").where(most).select("key", "node", "class", "n", *parts), scratch))
    other = held.select("key", F.col("node").alias("b"), F.col("class").alias("class_b"), F.col("n").alias("n_b"), *[F.col(c).alias(f"{c}_b") for c in parts])
    together = sum((F.least(F.col(c), F.col(f"{c}_b")) for c in parts), F.lit(0))
    between = held.withColumnRenamed("node", "a").join(other, "key").where((F.col("class") != F.col("class_b")) & (F.col("a") < F.col("b")) & (together >= F.lit(similarity - 1e-9) * (F.col("n") + F.col("n_b") - together)))
    rest = steady(between.select("a", "b").distinct().join(stars, ["a", "b"], "left_anti"))
    return steady(verified(rest, texts, shingle, similarity, counted).select("a", "b"))


def one_of_each(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id; of several rows with it, that of the smallest text. Rows with a null doc_id stay."""
    kept = found.where("doc_id = class_id").select(F.col("doc_id").alias(doc_id), "rows")
    once = docs.join(kept.where("rows = 1").select(doc_id), doc_id, "left_semi")
    often = docs.join(kept.where("rows > 1").select(doc_id), doc_id, "left_semi")
    whole = F.struct(docs[text], *[docs[c] for c in docs.columns if c != text])
    often = often.groupBy(docs[doc_id].alias("_id")).agg(F.min(whole).alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in docs.columns])
    once = once.select(*docs.columns)
    return once.unionByName(often).unionByName(docs.where(docs[doc_id].isNull()))
