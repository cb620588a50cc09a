"""Metrics of codecs: distances between barcodes and the errors that can be corrected."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hamming(a: str, b: str) -> int:
    return sum(x != y for x, y in zip(a, b, strict=True))


def shannon_bound(distance: int) -> int:
    """Errors that can be corrected at a minimum distance."""
    return max(0, (distance - 1) // 2)


def _minimum_distance(words: list[str]) -> int:
    """Smallest distance between any two of several distinct words of one width: that number of places which, left out, makes two words equal."""
    if len(words) <= 64:
        return min(hamming(a, b) for a, b in combinations(words, 2))
    letters = np.array([list(w.encode()) for w in words], np.uint8)
    width = letters.shape[1]
    salt = np.random.default_rng(1).integers(1, 1 << 62, (width, 256), dtype=np.uint64) | np.uint64(1)
    marked = salt[np.arange(width), letters]  # a hash of each base at its place; a word's is their sum
    with np.errstate(over="ignore"):
        whole = marked.sum(1, dtype=np.uint64)
        for distance in range(1, width):
            for places in combinations(range(width), distance):
                rest = np.sort(whole - marked[:, places].sum(1, dtype=np.uint64))
                if (rest[1:] == rest[:-1]).any():
                    return distance
    return width


def minimum_distances(barcodes: list[tuple[str, ...]]) -> tuple[int, ...]:
    """Smallest distance between distinct words of each segment; of one word alone, its width."""
    out = []
    for words in map(list, map(dict.fromkeys, zip(*barcodes, strict=True))):
        out.append(_minimum_distance(words) if len(words) > 1 else len(words[0]))
    return tuple(out)


def shannon_bounds(barcodes: list[tuple[str, ...]]) -> tuple[int, ...]:
    return tuple(map(shannon_bound, minimum_distances(barcodes)))


def codec_frame(spark: SparkSession, barcodes: list[tuple[str, ...]]) -> DataFrame:
    """(barcode_index, segment, word), a row per barcode and segment."""
    rows = [(i + 1, k, word) for i, segments in enumerate(barcodes) for k, word in enumerate(segments)]
    return spark.createDataFrame(rows, "barcode_index int, segment int, word string")


def distance_matrix(codec: DataFrame, width: int) -> DataFrame:
    """Distance and correctable errors of every pair of words of a segment, i < j. A codec is small, and so is its square."""
    a = codec.select("segment", F.col("barcode_index").alias("i"), F.col("word").alias("word_i"))
    b = codec.select("segment", F.col("barcode_index").alias("j"), F.col("word").alias("word_j"))
    apart = sum((F.when(F.substring("word_i", p + 1, 1) != F.substring("word_j", p + 1, 1), 1).otherwise(0) for p in range(width)), F.lit(0))
    pairs = a.join(F.broadcast(b), "segment").where("i < j").withColumn("distance", apart)
    return pairs.select("segment", "i", "j", "distance", F.greatest(F.floor((F.col("distance") - 1) / 2), F.lit(0)).cast("int").alias("bound"))


def matrix_text(words: list[str]) -> str:
    """Distances above and correctable errors below the diagonal."""
    lines = []
    for i, a in enumerate(words):
        cells = ["-" if i == j else str(hamming(a, b)) if i < j else str(shannon_bound(hamming(a, b))) for j, b in enumerate(words)]
        lines.append(f"{a}  " + " ".join(c.rjust(2) for c in cells))
    return "\n".join(lines)
