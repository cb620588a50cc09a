"""Connected components of links by alternating large-star and small-star steps, all in joins and pre-aggregated groups.

Both sides of each join are at rest before it, so that a node with very many neighbours can be split at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import common


def _least(both: DataFrame) -> DataFrame:
    """The smallest neighbour (or itself) of each u."""
    return both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(links: DataFrame, a: str = "a", b: str = "b", scratch: common.Scratch | None = None) -> DataFrame:
    """(node, class) of every node that has a link; class is the smallest node of its component. links: two long columns, any order, repeats allowed. scratch: takes the checkpoints on, to delete them."""
    steady = (scratch or common.Scratch()).steady
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    edges = steady(edges)
    before = None
    while True:
        # large star: neighbours above u go to u's smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = steady(both.join(steady(_least(both)), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        # small star: u and its neighbours below go to the smallest of them
        least = steady(_least(large))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = steady(small.where("u != v").distinct())
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before:
            break
        before = state
    tops = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("class"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("class")).unionByName(tops)
