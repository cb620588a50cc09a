"""Counts of decoded reads, estimated priors and quality profiles.

Counting is one pass: the results of all decoders are stacked into narrow rows and grouped by decoder and
class, so the shuffle holds a row per class and task. What is left, a row per class, is finished on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import sequences
from readloom.operators.decode import Decoder


def run_counts(df: DataFrame, qcfail: str = "qcfail") -> DataFrame:
    """One row: count, pf_count and pf_fraction."""
    passed = F.sum(F.when(F.col(qcfail), 0).otherwise(1))
    return df.agg(F.count("*").alias("count"), F.coalesce(passed, F.lit(0)).alias("pf_count")).withColumn("pf_fraction", F.when(F.col("count") > 0, F.col("pf_count") / F.col("count")).otherwise(0.0))


def barcode_counts(df: DataFrame, decoders: list[Decoder]) -> DataFrame:
    """Per decoder and (barcode_index, best_index): count, pf_count and sums of distance and confidence, with the reads that failed the noise and confidence filters."""
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("decoder"), F.col(f"{d.column}.barcode_index").alias("barcode_index"), F.col(f"{d.column}.best_index").alias("best_index"),
            F.col(f"{d.column}.distance").alias("distance"), F.col(f"{d.column}.confidence").alias("confidence"), F.col(f"{d.column}.low").alias("low"), (~F.col(f"{d.column}_qcfail")).alias("pf"),
            F.lit(d.algorithm == "pamld").alias("scored"),
        )
        for i, d in enumerate(decoders)
    ])
    flat = df.select(F.explode(rows).alias("r")).select("r.*")
    # confidence counts where the filters accept it, distance wherever a class is given
    accepted = F.col("scored") & (F.col("barcode_index") > 0) & (F.col("low") == "")
    return flat.groupBy("decoder", "barcode_index", "best_index").agg(
        F.count("*").alias("count"),
        F.count_if("pf").alias("pf_count"),
        F.sum("distance").cast("long").alias("distance"),
        F.sum(F.when(F.col("pf"), F.col("distance")).otherwise(0)).cast("long").alias("pf_distance"),
        F.sum(F.when(accepted, F.col("confidence")).otherwise(0.0)).alias("confidence"),
        F.sum(F.when(accepted & F.col("pf"), F.col("confidence")).otherwise(0.0)).alias("pf_confidence"),
        F.count_if(F.col("low") == "conditional").alias("low_conditional"),
        F.count_if(F.col("low") == "confidence").alias("low_confidence"),
    )


@dataclass
class Count:
    count: int = 0
    pf_count: int = 0
    distance: int = 0
    pf_distance: int = 0
    confidence: float = 0.0
    pf_confidence: float = 0.0
    low_conditional: int = 0
    low_confidence: int = 0


def _ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


@dataclass
class DecoderReport:
    """Counts of one decoder's classes (0: unclassified) and what follows from them."""

    decoder: Decoder
    by_index: list[Count]

    @property
    def classified(self) -> list[Count]:
        return self.by_index[1:]

    def _sum(self, what: str) -> float:
        return sum(getattr(c, what) for c in self.classified)

    @property
    def count(self) -> int:
        return sum(c.count for c in self.by_index)

    @property
    def pf_count(self) -> int:
        return sum(c.pf_count for c in self.by_index)

    @property
    def estimated_noise(self) -> float:
        """Reads that failed the noise filter, and of those that failed the confidence filter the same share as among the former and the accepted, over all."""
        low, unsure = self._sum("low_conditional"), self._sum("low_confidence")
        return _ratio(low + unsure * _ratio(low, low + self._sum("pf_count")), self.count)

    def estimated_concentration(self, index: int) -> float:
        return (1 - self.estimated_noise) * _ratio(self.by_index[index].pf_count, self._sum("pf_count"))

    def row(self, index: int) -> dict:
        """Counts and ratios of a class, under the report's names; ratios that are 0 are left out where the report leaves them out."""
        c, out = self.by_index[index], {}
        n, pf = self._sum("count"), self._sum("pf_count")
        out["count"], out["pf count"] = c.count, c.pf_count
        out["pooled fraction"], out["pf fraction"], out["pf pooled fraction"] = _ratio(c.count, self.count), _ratio(c.pf_count, c.count), _ratio(c.pf_count, self.pf_count)
        optional = {
            "average distance": _ratio(c.distance, c.count), "average confidence": _ratio(c.confidence, c.count), "average pf distance": _ratio(c.pf_distance, c.pf_count), "average pf confidence": _ratio(c.pf_confidence, c.pf_count),
            "low conditional confidence count": c.low_conditional, "low confidence count": c.low_confidence,
            "pooled classified fraction": _ratio(c.count, n), "pf pooled classified fraction": _ratio(c.pf_count, pf),
        }
        if index:
            optional["estimated concentration"] = self.estimated_concentration(index)
        return out | {k: v for k, v in optional.items() if v > 0}

    def totals(self) -> dict:
        n, pf = self._sum("count"), self._sum("pf_count")
        out = {
            "count": self.count, "pf count": self.pf_count, "classified count": n, "pf classified count": pf,
            "pf fraction": _ratio(self.pf_count, self.count), "classified fraction": _ratio(n, self.count), "pf classified fraction": _ratio(pf, self.pf_count), "classified pf fraction": _ratio(pf, n),
        }
        optional = {
            "low conditional confidence count": self._sum("low_conditional"), "low confidence count": self._sum("low_confidence"),
            "average classified distance": _ratio(self._sum("distance"), n), "average classified confidence": _ratio(self._sum("confidence"), n),
            "average pf classified distance": _ratio(self._sum("pf_distance"), pf), "average pf classified confidence": _ratio(self._sum("pf_confidence"), pf),
            "estimated noise": self.estimated_noise,
        }
        return out | {k: v for k, v in optional.items() if v > 0}


def decoder_reports(counts: DataFrame, decoders: list[Decoder]) -> list[DecoderReport]:
    """Reports of barcode_counts(), a row per class; classes without reads have zeros."""
    reports = [DecoderReport(d, [Count() for _ in range(1 + len(d.barcodes))]) for d in decoders]
    for r in counts.collect():
        into = reports[r["decoder"]].by_index
        c = into[r["barcode_index"]]
        for k in ("count", "pf_count", "distance", "pf_distance", "confidence", "pf_confidence"):
            setattr(c, k, getattr(c, k) + r[k])
        # reads that failed a filter are charged to the class that was preferred
        into[r["best_index"]].low_conditional += r["low_conditional"]
        into[r["best_index"]].low_confidence += r["low_confidence"]
    return reports


def barcode_table(counts: DataFrame, codec: DataFrame) -> DataFrame:
    """The classes of one decoder as a frame: counts with ratios to the decoder's totals, and estimated priors. codec: (barcode_index) of all classes, 0 too."""
    own = counts.groupBy("barcode_index").agg(*[F.sum(c).alias(c) for c in ("count", "pf_count", "distance", "pf_distance", "confidence", "pf_confidence")])
    low = counts.groupBy(F.col("best_index").alias("barcode_index")).agg(F.sum("low_conditional").alias("low_conditional"), F.sum("low_confidence").alias("low_confidence"))
    names = ("count", "pf_count", "distance", "pf_distance", "confidence", "pf_confidence", "low_conditional", "low_confidence")
    table = codec.select("barcode_index").join(own, "barcode_index", "left").join(low, "barcode_index", "left").fillna(0, list(names))
    everything = Window.partitionBy()  # a row per class
    total = lambda c: F.sum(c).over(everything)
    of_class = lambda c: F.sum(F.when(F.col("barcode_index") > 0, F.col(c)).otherwise(0)).over(everything)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    table = table.withColumns({"_n": total("count"), "_pf": total("pf_count"), "_classified": of_class("count"), "_pf_classified": of_class("pf_count"), "_low": of_class("low_conditional"), "_unsure": of_class("low_confidence")})
    noise = ratio(F.col("_low") + F.col("_unsure") * ratio(F.col("_low"), F.col("_low") + F.col("_pf_classified")), F.col("_n"))
    return table.select(
        "barcode_index", "count", "pf_count", "low_conditional", "low_confidence",
        ratio(F.col("distance"), F.col("count")).alias("average_distance"), ratio(F.col("confidence"), F.col("count")).alias("average_confidence"),
        ratio(F.col("pf_distance"), F.col("pf_count")).alias("average_pf_distance"), ratio(F.col("pf_confidence"), F.col("pf_count")).alias("average_pf_confidence"),
        ratio(F.col("pf_count"), F.col("count")).alias("pf_fraction"), ratio(F.col("count"), F.col("_n")).alias("pooled_fraction"), ratio(F.col("pf_count"), F.col("_pf")).alias("pf_pooled_fraction"),
        ratio(F.col("count"), F.col("_classified")).alias("pooled_classified_fraction"), ratio(F.col("pf_count"), F.col("_pf_classified")).alias("pf_pooled_classified_fraction"),
        noise.alias("estimated_noise"),
        F.when(F.col("barcode_index") > 0, (1 - noise) * ratio(F.col("pf_count"), F.col("_pf_classified"))).otherwise(0.0).alias("estimated_concentration"),
    )


# ---------------------------------------------------------------- quality profiles


def bases_with_quality(df: DataFrame, sequence: Column, qualities: Column, keep: list[str], offset: int = sequences.PHRED_OFFSET) -> DataFrame:
    """A row per base: the columns in keep, cycle (from 0), base and quality (0 to 41, held there)."""
    one = df.select(*keep, F.posexplode(F.split(sequence, "")).alias("cycle", "base"), qualities.alias("_quality")).where("base != ''")
    q = F.ascii(F.expr("substring(_quality, cycle + 1, 1)")) - offset
    return one.select(*keep, "cycle", "base", F.greatest(F.least(q, F.lit(sequences.PHRED_BINS - 1)), F.lit(0)).alias("quality"))


#: Bytes of counts that a task holds before it hands them on.
_HELD = 64 << 20


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of ASCII strings, nulls empty."""
    column = column.cast(pa.string()).fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2]
    return ends, np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(1, np.uint8)


def base_counts(df: DataFrame, sequence: Column, qualities: Column, keep: list[str], offset: int = sequences.PHRED_OFFSET) -> DataFrame:
    """Partial counts n of bases per keep (integers), cycle (from 0), base and quality (0 to 41, held there), counted where the reads are: a few rows a task and no row a base."""
    letters, bins = sequences.IUPAC, sequences.PHRED_BINS
    code = np.full(256, letters.index("N"), np.int64)
    code[[ord(c) for c in letters]] = range(len(letters))
    names = [*keep, "cycle", "base", "quality", "n"]

    def emit(held: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        parts = [[] for _ in names]
        for key, counts in held.items():
            cycle, letter, quality = np.nonzero(counts)
            for column, value in zip(parts, [*(np.full(len(cycle), k) for k in key), cycle, letter, quality, counts[cycle, letter, quality]], strict=True):
                column.append(value)
        joined = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in parts]
        shown = pa.array(np.array(list(letters), object)[joined[-3]], pa.string())
        return pa.record_batch([*(pa.array(c, pa.int32()) for c in joined[:-3]), shown, pa.array(joined[-2], pa.int32()), pa.array(joined[-1], pa.int64())], names)

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(keep))]) if keep else np.zeros((batch.num_rows, 0), np.int64)
            (begin, bases), (begin_q, quals) = _buffers(batch.column(len(keep))), _buffers(batch.column(len(keep) + 1))
            length, length_q = np.diff(begin), np.diff(begin_q)
            if not length.sum():
                continue
            combos, which = np.unique(keys, axis=0, return_inverse=True)
            row = np.repeat(np.arange(batch.num_rows), length)
            cycle = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
            letter = code[bases[begin[0] : begin[-1]]]
            quality = np.where(cycle < length_q[row], quals[np.minimum(begin_q[:-1][row] + cycle, len(quals) - 1)].astype(np.int64) - offset, 0).clip(0, bins - 1)
            shape = (len(combos), int(length.max()), len(letters), bins)
            cell = ((which.reshape(-1)[row] * shape[1] + cycle) * shape[2] + letter) * shape[3] + quality
            if np.prod(shape) <= _HELD // 8:
                dense = np.bincount(cell, minlength=int(np.prod(shape))).reshape(shape)
                found = ((tuple(k), dense[i]) for i, k in enumerate(combos.tolist()))
            else:
                found = ((tuple(k), np.bincount(cell[which[row] == i] - i * int(np.prod(shape[1:])), minlength=int(np.prod(shape[1:]))).reshape(shape[1:])) for i, k in enumerate(combos.tolist()))
            for key, counts in found:
                old = held.get(key)
                if old is not None:
                    long, short = (counts, old) if len(counts) >= len(old) else (old, counts)
                    long = long.copy()
                    long[: len(short)] += short
                    counts = long
                held[key] = counts
                if sum(c.nbytes for c in held.values()) > _HELD:
                    yield emit(held)
                    held.clear()
        yield emit(held)

    narrow = df.select(*[F.col(k).cast("int").alias(k) for k in keep], sequence.alias("_sequence"), qualities.alias("_qualities"))
    return narrow.mapInArrow(run, ", ".join([*(f"{k} int" for k in keep), "cycle int, base string, quality int, n long"]))


def cycle_histogram(counts: DataFrame, keep: list[str]) -> DataFrame:
    """Reads per (keep, cycle, base, quality), and per cycle and quality over all bases (base '*'). counts: of base_counts()."""
    keys = [*keep, "cycle", "base", "quality"]
    sets = [[F.col(k) for k in keys], [F.col(k) for k in keys if k != "base"]]
    return counts.groupingSets(sets, *keys).agg(F.sum("n").alias("n")).select(*keep, "cycle", F.coalesce("base", F.lit("*")).alias("base"), "quality", "n")


def histogram_stats(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """Count, sum, mean, extremes and quartiles of quality histograms (quality, n). A quantile p is the lowest quality up to which floor(p * count) reads lie, 0 if that is none; the minimum leaves 0 out unless there is nothing else."""
    by = Window.partitionBy(*keys).orderBy("quality")
    walked = histogram.withColumns({"_up_to": F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)), "_count": F.sum("n").over(Window.partitionBy(*keys))})

    def quantile(p: float) -> Column:
        wanted = F.floor(F.col("_count") * p)
        return F.when(F.first("_count") * p < 1, 0).otherwise(F.min(F.when(F.col("_up_to") >= wanted, F.col("quality"))))

    stats = walked.groupBy(*keys).agg(
        F.sum("n").alias("count"), F.sum(F.col("n") * F.col("quality")).alias("sum_quality"), F.max("quality").alias("max_quality"),
        F.coalesce(F.min(F.when(F.col("quality") > 0, F.col("quality"))), F.lit(0)).alias("min_quality"),
        quantile(0.25).alias("q1"), quantile(0.5).alias("median_quality"), quantile(0.75).alias("q3"),
    )
    spread = (F.col("q3") - F.col("q1")) * 1.5
    return stats.withColumns({
        "mean_quality": F.col("sum_quality") / F.col("count"), "iqr": F.col("q3") - F.col("q1"),
        "left_whisker": F.greatest(F.col("q1") - spread, F.col("min_quality").cast("double")), "right_whisker": F.least(F.col("q3") + spread, F.col("max_quality").cast("double")),
    })


def average_quality(qualities: Column, offset: int = sequences.PHRED_OFFSET) -> Column:
    """Mean quality of a read; null for an empty one."""

    def kernel(column: pa.Array) -> pa.Array:
        column = column.fill_null("")
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if column.buffers()[2] and len(column) else np.zeros(0, np.uint8)
        total = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])[ends - ends[0]]
        length = np.diff(ends)
        return pa.array((np.diff(total) - offset * length) / np.maximum(length, 1), pa.float64(), mask=length == 0)

    return F.arrow_udf(kernel, "double")(qualities)
