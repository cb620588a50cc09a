"""Mixing sources to target weights by cube-method balanced sampling.

Each source has a target in words; a document of it is taken floor(target / size) times, and once more with
the fraction as its inclusion probability. The cube method rounds these probabilities: as long as three
documents are undecided, their probabilities move along the null space of the two balancing constraints
(documents, words) until one reaches 0 or 1, so that both totals stay what they were. This flight runs in
blocks of a bounded number of rows of one source, in parallel; at most two documents of a block stay undecided,
and these meet in the next level's blocks, until one block a source is left. Its last documents are the
landing problem: the two undecided ones and a dozen held back from the flight, of sizes from the largest to the
smallest, are rounded together, of all ways the one whose word total is nearest (then whose document total is).

The driver sees one row a source (their number is taken to be bounded, as targets are given by source).
Randomness comes from a hash of source and block, so reruns agree. Equal rows are counted first and numbered then, so
that they are dealt to blocks like other rows, however many they are.

Defined results: null source is a source of its own; null and empty texts have size 0 and move no word total;
repeated rows are decided each on its own; null doc_ids are allowed; ties in size go by a hash of doc_id and text; an
empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import common

#: Rows of a block.
BLOCK = 4096
#: Weights of the sources in code point order, repeating; null comes last.
WEIGHTS = (3, 1, 2)
#: Documents of a source that are held back for the landing; all their subsets are weighed.
LANDING = 12
#: Equal rows that are numbered at once.
NUMBERED = 1024
#: Share of all words that the mix takes, and the most that it takes of a source.
SHARE, MOST = 1.5, 2.0
#: A word, for sizes.
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words to take of each source: shares by weight, held at `most` times the source's size, the excess shared anew by weight."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not above:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: most * sizes[s] for s in above}
        left -= sum(most * sizes[s] for s in above)
        open_ = [s for s in open_ if s not in above]
    return out


def flight(size: np.ndarray, p: np.ndarray, draws: np.random.Generator, land: bool) -> np.ndarray:
    """Move probabilities to 0 or 1 with the sum of p and of p * size kept; at most two stay between, none if land."""
    z, q = [float(x) for x in size], [float(x) for x in p]
    waiting = iter(range(len(q)))
    active: list[int] = []
    tiny = 1e-9

    def settle() -> None:
        for i in active:
            if q[i] < tiny or q[i] > 1 - tiny:
                q[i] = float(round(q[i]))
        active[:] = [i for i in active if 0.0 < q[i] < 1.0]

    def move(direction: list[float]) -> None:
        up = min((1 - q[i]) / d if d > 0 else q[i] / -d for i, d in zip(active, direction, strict=True) if d)
        down = min(q[i] / d if d > 0 else (1 - q[i]) / -d for i, d in zip(active, direction, strict=True) if d)
        by = up if draws.random() * (up + down) < down else -down
        for i, d in zip(active, direction, strict=True):
            q[i] += by * d
        settle()

    undecided = [i for i in range(len(q)) if 0.0 < q[i] < 1.0]
    held = {undecided[i] for i in np.linspace(0, len(undecided) - 1, min(LANDING, len(undecided))).astype(int)} if land and undecided else set()
    aim = sum(z[i] * q[i] for i in undecided), sum(q[i] for i in undecided)
    while True:
        while len(active) < 3 and (i := next(waiting, None)) is not None:
            if 0.0 < q[i] < 1.0 and i not in held:
                active.append(i)
        if len(active) < 3:
            break
        a, b, c = (z[i] for i in active)
        top = max(abs(b - c), abs(c - a), abs(a - b))
        move([(b - c) / top, (c - a) / top, (a - b) / top] if top else [1.0, -1.0, 0.0])
    if land and undecided:
        last = [*active, *sorted(held)]
        settled = [i for i in undecided if i not in last]
        picks = np.arange(1 << len(last))[:, None] >> np.arange(len(last)) & 1
        words = abs(picks @ np.array([z[i] for i in last]) + sum(z[i] * q[i] for i in settled) - aim[0])
        documents = abs(picks.sum(1) + sum(q[i] for i in settled) - aim[1])
        for i, x in zip(last, picks[np.lexsort((documents, np.round(words, 6)))[0]], strict=True):
            q[i] = float(x)
    return np.array(q)



def _decide(land: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "tie", "doc_id", "nth"], ascending=[False, True, True, True], kind="stable")
        seed = zlib.crc32(repr((key[0], int(key[1]), land)).encode())
        rows["p"] = flight(rows["size"].to_numpy(), rows["p"].to_numpy(), np.random.Generator(np.random.PCG64(seed)), land)
        return rows.drop(columns="block")

    return run


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies (how often the mix takes it) and tie (a hash of doc_id and text)."""
    body = docs[text].cast("string")
    sized = docs.select(
        docs[doc_id].cast("long").alias("doc_id"),
        docs[source].cast("string").alias("source"),
        F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(docs[doc_id].cast("long"), body).alias("tie"),
    )
    scratch = common.Scratch()
    sized = scratch.steady(sized.groupBy("doc_id", "source", "size", "tie").agg(F.count("*").alias("n")))
    totals = {r["source"]: (r["size"], r["n"]) for r in sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")).collect()}
    target = targets({s: v[0] for s, v in totals.items()}, weights, share, most)
    rows = [(s, size, float(target[s]), target[s] / size if size else 0.0, math.ceil(n / BLOCK)) for s, (size, n) in totals.items()]
    plan = common.small_table(docs.sparkSession, rows, "source string, source_size long, target double, ratio double, blocks long")
    # equal rows get numbers, in parts that are dealt out where there are many
    parts = sized.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {NUMBERED} as int)"))))
    if not sized.where(F.col("n") > NUMBERED).isEmpty():
        parts = parts.repartition("tie", "part")
    first = F.col("part").cast("long") * NUMBERED
    sized = parts.withColumn("nth", F.explode(F.sequence(first, F.least(F.col("n"), first + NUMBERED) - 1))).drop("n", "part")
    same = F.col("plan.source").eqNullSafe(F.col("rows.source"))
    planned = sized.alias("rows").join(F.broadcast(plan).alias("plan"), same).select("rows.*", "plan.blocks", F.floor("ratio").alias("copies"), (F.col("ratio") - F.floor("ratio")).alias("p"))
    level, blocks, done = planned, max([r[4] for r in rows], default=1), []
    schema = "doc_id long, source string, size long, tie long, nth long, blocks long, copies long, p double"
    while True:
        blocked = level.withColumn("block", F.pmod(F.xxhash64("tie", "nth", F.lit(blocks)), F.greatest("blocks", F.lit(1))))
        moved = blocked.groupBy("source", "block").applyInPandas(_decide(land=blocks <= 1), schema)
        if blocks <= 1:
            done.append(moved)
            break
        moved = scratch.steady(moved)
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(moved.where(~open_))
        # a block leaves two rows at most
        level = moved.where(open_).withColumn("blocks", F.ceil(F.col("blocks") * 2 / BLOCK))
        blocks = math.ceil(blocks * 2 / BLOCK)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.alias("rows").join(F.broadcast(plan).alias("plan"), same)
    return scratch.result(out.select("rows.doc_id", "rows.source", "rows.size", "plan.source_size", "plan.target", (F.col("copies") + F.col("p").cast("long")).alias("copies"), "rows.tie"))
