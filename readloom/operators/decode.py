"""Decoders: match the observed barcode of a read against a closed list.

Every decoder adds one struct column:

    raw, raw_quality     the observed bases and qualities, segments joined
    lengths              the observed bases of each segment (null for a single one)
    barcode_index        the class, 0 for unclassified
    best_index           the class that a likelihood decoder preferred before its filters, 0 for none
    distance             mismatches to the class
    high_quality_distance  mismatches of high quality to the preferred class
    conditional, confidence  likelihood and posterior of the class
    low                  the filter that the read failed: '', 'confidence' or 'conditional'
    fail                 the read fails quality control here

Scores come from one Arrow kernel, which works on some reads of a batch at a time, the fewer the larger the codec is.
Likelihoods are rounded as in SQL, to the last bit; distances are matrix products. Each segment is held against its own part of a barcode, however short
it was read. Barcodes whose likelihoods differ by less than rounding are equal, and the first one is taken. Codecs of at most `unrolled` base comparisons may become JVM expressions instead; both give the same classes.
The kernel is the default: it was faster even for 16 barcodes of 8 bases, and a filter on a decoder's result
stays above it, where the optimiser would copy unrolled scores into every use.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import sequences, tokens
from readloom.functions.tokens import Transform


#: Likelihoods that differ by less than this share are equal.
TIE = 1e-9
#: Cells of a matrix of reads and barcodes that a kernel holds at once.
CELLS = 1 << 21


@dataclass(frozen=True)
class Barcode:
    key: str
    segments: tuple[str, ...]
    concentration: float = 1.0
    #: Read group and further attributes.
    attributes: dict = field(default_factory=dict, hash=False, compare=False)

    @property
    def flat(self) -> str:
        return "".join(self.segments)


@dataclass(frozen=True)
class Decoder:
    """A compiled decoder. barcodes are in codec order, their index is their place plus 1."""

    topic: str
    algorithm: str
    transform: Transform = Transform((), ())
    barcodes: tuple[Barcode, ...] = ()
    undetermined: Barcode = Barcode("undetermined", ())
    noise: float = 0.01
    confidence_threshold: float = 0.95
    random_probability: float | None = None
    quality_masking_threshold: int = 0
    distance_tolerance: tuple[int, ...] | None = None
    high_quality_threshold: int = 30
    high_quality_distance_threshold: int = 0
    corrected_quality: int = 30
    multiplexing: bool = False
    number: int = 0

    @property
    def width(self) -> int:
        return sum(self.transform.widths())

    @property
    def random(self) -> float:
        """Chance of a random barcode, one of 4^width unless given."""
        return self.random_probability if self.random_probability is not None else 0.25**self.width

    @property
    def tolerance(self) -> tuple[int, ...]:
        from readloom.operators.metrics import shannon_bounds

        return self.distance_tolerance if self.distance_tolerance is not None else shannon_bounds([b.segments for b in self.barcodes])

    @property
    def column(self) -> str:
        return f"{self.topic}_{self.number}"

    @property
    def comparisons(self) -> int:
        return sum(len(b.flat) for b in self.barcodes)


def _result(**given: Column) -> Column:
    defaults = {
        "raw": F.lit(""), "raw_quality": F.lit(""), "lengths": F.lit(None).cast("array<int>"), "barcode_index": F.lit(0), "best_index": F.lit(0), "distance": F.lit(0), "high_quality_distance": F.lit(0),
        "conditional": F.lit(0.0), "confidence": F.lit(0.0), "low": F.lit(""), "fail": F.lit(False),
    }
    return F.struct(*[given.get(k, v).alias(k) for k, v in defaults.items()])


def _pick(scores: list[Column], best: Column, values: list) -> Column:
    """The value that belongs to the first score equal to the best."""
    out = None
    for s, v in zip(scores, values, strict=True):
        v = v if isinstance(v, Column) else F.lit(v)
        tied = s >= best * (1 - TIE)
        out = F.when(tied, v) if out is None else out.when(tied, v)
    return out


def _filters(decoder: Decoder) -> Column:
    """The noise, confidence and high-quality filters over scored columns best, conditional, confidence, distance and high_quality_distance."""
    likely = (F.col("_best") > 0) & (F.col("_conditional") > decoder.random)
    sure = F.col("_confidence") > decoder.confidence_threshold
    bad = F.lit(False) if decoder.high_quality_distance_threshold <= 0 else F.col("_high") >= decoder.high_quality_distance_threshold
    return _result(
        raw=F.col("_raw"), raw_quality=F.col("_raw_quality"), lengths=F.col("_lengths"),
        barcode_index=F.when(likely, F.col("_best")).otherwise(0), best_index=F.col("_best"),
        distance=F.when(likely, F.col("_distance")).otherwise(0), high_quality_distance=F.col("_high"),
        conditional=F.col("_conditional"), confidence=F.when(likely, F.col("_confidence")).otherwise(0.0),
        low=F.when(F.col("_best") == 0, "").when(~likely, "conditional").when(~sure, "confidence").otherwise(""),
        fail=~likely | ~sure | bad,
    )


def listed(values: list[str]) -> Column:
    """A constant array of texts without control characters: one literal, whatever its length."""
    return F.split(F.lit("\n".join(values)), "\n", -1)


def _likelihood_unrolled(df: DataFrame, decoder: Decoder, offset: int) -> DataFrame:
    width, raw, qualities = decoder.width, F.col("_padded"), F.col("_padded_quality")
    place = {f"_o{j}": sequences.base(raw, j) for j in range(width)} | {f"_q{j}": F.when(F.length(qualities) > j, sequences.quality(qualities, j, offset)).otherwise(0) for j in range(width)}
    df = df.withColumns(place)
    costs = F.array(*[F.lit(c) for c in sequences.MATCH_COSTS])
    terms: dict[str, Column] = {}
    for j in range(width):
        o, q = F.col(f"_o{j}"), F.col(f"_q{j}")
        known = o.isin(*sequences.UNAMBIGUOUS)
        # cost of a base that differs, and what an equal one saves; a base without quality or that is missing says nothing
        terms[f"_m{j}"] = F.when(q <= 0, 0.0).when(known, q.cast("double")).otherwise(sequences.UNIFORM_COST)
        terms[f"_d{j}"] = F.when((q > 0) & known, F.element_at(costs, F.least(q, F.lit(len(sequences.MATCH_COSTS) - 1)) + 1) - q).otherwise(0.0)
    df = df.withColumns(terms)
    mismatch = sequences.total([F.col(f"_m{j}") for j in range(width)])
    scores = {}
    for i, b in enumerate(decoder.barcodes):
        saved = [F.when(F.col(f"_o{j}") == c, F.col(f"_d{j}")).otherwise(0.0) if c in sequences.UNAMBIGUOUS else F.when(F.col(f"_q{j}") > 0, F.lit(sequences.UNIFORM_COST) - F.col(f"_m{j}")).otherwise(0.0) for j, c in enumerate(b.flat)]
        scores[f"_c{i}"] = F.pow(F.lit(10.0), (F.col("_mismatch") + sequences.total(saved)) / F.lit(-10.0))
    df = df.withColumn("_mismatch", mismatch).withColumns(scores)
    joint = [F.col(f"_c{i}") * F.lit(b.concentration) for i, b in enumerate(decoder.barcodes)]
    df = df.withColumns({f"_j{i}": c for i, c in enumerate(joint)})
    joint = [F.col(f"_j{i}") for i in range(len(joint))]
    df = df.withColumn("_top", F.greatest(*joint) if len(joint) > 1 else joint[0])
    df = df.withColumns({
        "_best": F.when(F.col("_top") > 0, _pick(joint, F.col("_top"), list(range(1, len(joint) + 1)))).otherwise(0),
        "_conditional": F.when(F.col("_top") > 0, _pick(joint, F.col("_top"), [F.col(f"_c{i}") for i in range(len(joint))])).otherwise(0.0),
        "_confidence": F.when(F.col("_top") > 0, F.col("_top") / (sequences.total(joint) + F.lit(decoder.noise * decoder.random))).otherwise(0.0),
    })
    words = F.element_at(listed([b.flat for b in decoder.barcodes]), F.greatest(F.col("_best"), F.lit(1)))
    df = df.withColumn("_word", words)
    miss = [F.substring("_word", j + 1, 1) != F.col(f"_o{j}") for j in range(width)]
    return df.withColumns({
        "_distance": F.when(F.col("_best") > 0, sequences.total([F.when(m, 1).otherwise(0) for m in miss])).otherwise(0),
        "_high": F.when(F.col("_best") > 0, sequences.total([F.when(m & (F.col(f"_q{j}") >= decoder.high_quality_threshold), 1).otherwise(0) for j, m in enumerate(miss)])).otherwise(0) if decoder.high_quality_threshold > 0 else F.lit(0),
    })


def _letters(column: pa.Array, width: int) -> np.ndarray:
    """(n, width) code points of ASCII strings, 0 beyond their end."""
    column = column.fill_null("")
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(1, np.uint8)
    length = np.diff(ends)
    if n and (length == width).all():
        return data[ends[0] : ends[-1]].reshape(n, width)
    place = ends[:-1, None] + np.arange(width)
    return np.where(np.arange(width) < length[:, None], data[np.minimum(place, len(data) - 1)], 0).astype(np.uint8)


def score_batch(raw: np.ndarray, quality: np.ndarray, words: np.ndarray, concentration: np.ndarray, noise_floor: float, high: int) -> dict[str, np.ndarray]:
    """Likelihood scores of a batch, some reads at a time. raw, quality: (n, width) letters (0: missing) and qualities; words: (barcodes, width) letters.

    Error probabilities are printed with six digits of what a confidence near 1 leaves, so each step rounds as SQL does, whatever the batch and the processor: costs are added from the first
    base to the last, joint likelihoods from the largest to the smallest, and powers are those of the C library (Arrow's; numpy has its own on some processors)."""
    costs = np.array(sequences.MATCH_COSTS)
    bases = np.frombuffer(sequences.UNAMBIGUOUS.encode(), np.uint8)
    n, width = raw.shape
    q = np.where(raw == 0, 0, quality)
    known = np.isin(raw, bases)
    differs = np.where(q <= 0, 0.0, np.where(known, q, sequences.UNIFORM_COST))
    equals = np.where((q > 0) & known, costs[np.clip(q, 0, len(costs) - 1)], differs)
    vague = np.where(q > 0, sequences.UNIFORM_COST, 0.0)
    # the row of a place's costs that a barcode takes: one for each base, the last for ambiguous ones
    taken = np.where(np.isin(words, bases), np.searchsorted(bases, words), len(bases))
    best, top, chosen, total = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n)
    step = max(1, CELLS // len(words))
    for at in range(0, n, step):
        some = slice(at, at + step)
        cost = np.zeros((len(words), len(raw[some])))
        for j in range(width):
            cost += np.vstack([*(np.where(raw[some, j] == b, equals[some, j], differs[some, j]) for b in bases), vague[some, j]])[taken[:, j]]
        conditional = pc.power(10.0, pa.array((cost / -10.0).ravel())).to_numpy().reshape(cost.shape)
        joint = conditional * concentration[:, None]
        # the first of those that are equal but for rounding
        first = (joint >= joint.max(0) * (1 - TIE)).argmax(0)
        rows = np.arange(len(first))
        best[some], top[some], chosen[some] = first, joint[first, rows], conditional[first, rows]
        total[some] = np.add.accumulate(np.sort(joint.T, axis=1)[:, ::-1], axis=1)[:, -1]
    some = top > 0
    miss = words[best] != raw
    return {
        "best": np.where(some, best + 1, 0), "conditional": np.where(some, chosen, 0.0),
        "confidence": np.where(some, top / np.maximum(total + noise_floor, 1e-300), 0.0),
        "distance": np.where(some, miss.sum(1), 0), "high": np.where(some & (high > 0), (miss & (q >= high)).sum(1), 0),
    }


def _likelihood_kernel(df: DataFrame, decoder: Decoder, offset: int) -> DataFrame:
    width = decoder.width
    words = np.array([list(b.flat.encode()) for b in decoder.barcodes], np.uint8)
    concentration = np.array([b.concentration for b in decoder.barcodes])
    floor, high = decoder.noise * decoder.random, decoder.high_quality_threshold
    kind = pa.struct([("best", pa.int32()), ("conditional", pa.float64()), ("confidence", pa.float64()), ("distance", pa.int32()), ("high", pa.int32())])

    def kernel(raw: pa.Array, quality: pa.Array) -> pa.Array:
        got = score_batch(_letters(raw, width), _letters(quality, width).astype(np.int64) - offset, words, concentration, floor, high)
        return pa.StructArray.from_arrays([pa.array(got[f.name], f.type) for f in kind], fields=list(kind))

    # said to be nondeterministic, so that a filter on the result isn't pushed below it and makes it run twice
    scored = F.arrow_udf(kernel, "best int, conditional double, confidence double, distance int, high int").asNondeterministic()(F.col("_padded"), F.col("_padded_quality"))
    df = df.withColumn("_scored", scored)
    return df.withColumns({f"_{f.name}": F.col(f"_scored.{f.name}") for f in kind}).drop("_scored")


def _likelihood(df: DataFrame, decoder: Decoder, observed: list[tuple[Column, Column]], offset: int, unrolled: int) -> tuple[DataFrame, Column]:
    scorer = _likelihood_unrolled if decoder.comparisons <= unrolled else _likelihood_kernel
    return scorer(df, decoder, offset), _filters(decoder)


def _minimum_distance(df: DataFrame, decoder: Decoder, observed: list[tuple[Column, Column]], offset: int, unrolled: int) -> tuple[DataFrame, Column]:
    """An exact match by lookup, else the first barcode of which every segment is within its tolerance."""
    names = [(f"_s{i}", f"_t{i}") for i in range(len(observed))]
    if decoder.comparisons > unrolled:
        near = _near_kernel(decoder, offset)(F.col("_raw"), *[F.col(c) for pair in names for c in pair])
        df = df.withColumn("_near", near)
        found, distance = F.col("_near.index"), F.col("_near.distance")
    else:
        found = distance = None
        exact = lambda b: F.col("_raw") == b.flat
        for i, b in enumerate(decoder.barcodes):
            found = F.when(exact(b), i + 1) if found is None else found.when(exact(b), i + 1)
            distance = F.when(exact(b), 0) if distance is None else distance.when(exact(b), 0)
        for i, b in enumerate(decoder.barcodes):
            apart = [sequences.hamming_of_observed(F.col(s), word, F.col(q), decoder.quality_masking_threshold, offset) for (s, q), word in zip(names, b.segments, strict=True)]
            df = df.withColumns({f"_apart{i}_{k}": a for k, a in enumerate(apart)})
            apart = [F.col(f"_apart{i}_{k}") for k in range(len(apart))]
            within = F.lit(True)
            for a, most in zip(apart, decoder.tolerance, strict=True):
                within = within & (a <= most)
            found, distance = found.when(within, i + 1), distance.when(within, sequences.total(apart))
        found, distance = found.otherwise(0), distance.otherwise(0)
    return df, _result(raw=F.col("_raw"), raw_quality=F.col("_raw_quality"), lengths=F.col("_lengths"), barcode_index=found, best_index=found, distance=distance, fail=found == 0)


def nearest(segments: list[np.ndarray], words: list[np.ndarray], tolerance: tuple[int, ...], low: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first barcode of which every segment is within its tolerance (0: none), and its distance. segments, words: (n, width) letters of each segment, 0 beyond the end of a short one; low: bases that count as errors whatever they are."""
    n = len(segments[0])
    index, distance = np.zeros(n, np.int32), np.zeros(n, np.int32)
    letters = np.frombuffer(sequences.IUPAC.encode(), np.uint8)
    # agreeing bases are counted by one product of one-hot letters a segment
    left, length = [], []
    for k, raw in enumerate(segments):
        seen = raw if low is None else np.where(low[k], 1, raw)
        left.append(np.hstack([seen == c for c in letters]).astype(np.float32))
        length.append((raw != 0).sum(1).astype(np.float32))
    left_over = np.arange(n)
    step = max(64, CELLS // max(1, n))
    for at in range(0, len(words[0]), step):
        if not len(left_over):
            break
        within, total = True, 0
        for k, word in enumerate(words):
            some = word[at : at + step]
            right = np.hstack([some == c for c in letters]).astype(np.float32)
            apart = length[k][left_over, None] - left[k][left_over] @ right.T
            within, total = within & (apart <= tolerance[k]), total + apart
        first = within.argmax(1)
        hit = within[np.arange(len(first)), first]
        index[left_over[hit]] = at + first[hit] + 1
        distance[left_over[hit]] = total[np.flatnonzero(hit), first[hit]]
        left_over = left_over[~hit]
    return index, distance


def _near_kernel(decoder: Decoder, offset: int) -> Callable[..., Column]:
    """The barcode that equals the observed bases, found by binary search, else the first one within tolerance."""
    words = [np.array([list(b.segments[k].encode()) for b in decoder.barcodes], np.uint8) for k in range(len(decoder.transform.knit))]
    flat = np.array([b.flat for b in decoder.barcodes], f"S{decoder.width}")
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    tolerance, mask = decoder.tolerance, decoder.quality_masking_threshold
    kind = pa.struct([("index", pa.int32()), ("distance", pa.int32())])

    def kernel(*columns: pa.Array) -> pa.Array:
        n = len(columns[0])
        seen = np.ascontiguousarray(_letters(columns[0], decoder.width)).view(f"S{decoder.width}").reshape(n)
        place = np.minimum(np.searchsorted(ordered, seen), len(ordered) - 1)
        index = np.where(ordered[place] == seen, order[place] + 1, 0).astype(np.int32)
        distance = np.zeros(n, np.int32)
        rest = np.flatnonzero(index == 0)
        if len(rest):
            segments = [_letters(columns[1 + 2 * k], word.shape[1])[rest] for k, word in enumerate(words)]
            low = [(_letters(columns[2 + 2 * k], word.shape[1])[rest].astype(np.int64) - offset < mask) & (segments[k] != 0) for k, word in enumerate(words)] if mask > 0 else None
            index[rest], distance[rest] = nearest(segments, words, tolerance, low)
        return pa.StructArray.from_arrays([pa.array(index), pa.array(distance)], fields=list(kind))

    def call(*columns: Column) -> Column:
        return F.arrow_udf(kernel, "index int, distance int").asNondeterministic()(*columns)

    kernel.__annotations__ = {"columns": pa.Array, "return": pa.Array}
    return call


def _naive(df: DataFrame, decoder: Decoder, observed: list[tuple[Column, Column]], offset: int, unrolled: int) -> tuple[DataFrame, Column]:
    return df, _result(raw=F.col("_raw"), raw_quality=F.col("_raw_quality"), lengths=F.col("_lengths"))


def _passthrough(df: DataFrame, decoder: Decoder, observed: list[tuple[Column, Column]], offset: int, unrolled: int) -> tuple[DataFrame, Column]:
    return df, _result()


def _joined(decoder: Decoder, n: int, offset: int) -> dict[str, Column]:
    """The segments joined as they are, and each filled to its width, with bases of code 0 and quality 0, so that a short one moves none behind it."""
    bases, qualities = [F.col(f"_s{i}") for i in range(n)], [F.col(f"_t{i}") for i in range(n)]
    if n == 1:
        return {"_raw": bases[0], "_raw_quality": qualities[0], "_padded": bases[0], "_padded_quality": qualities[0], "_lengths": F.lit(None).cast("array<int>")}
    out = {"_raw": F.concat(*bases), "_raw_quality": F.concat(*qualities), "_lengths": F.array(*[F.length(b) for b in bases])}
    if decoder.algorithm != "pamld":
        return out
    widths = decoder.transform.widths()
    padded = lambda columns, fill: F.concat(*[F.rpad(c, w, fill) for c, w in zip(columns[:-1], widths[:-1], strict=True)], columns[-1])
    return out | {"_padded": padded(bases, "\0"), "_padded_quality": padded(qualities, chr(offset))}


Builder = Callable[[DataFrame, Decoder, list, int, int], tuple[DataFrame, Column]]
_ALGORITHMS: dict[str, Builder] = {"pamld": _likelihood, "mdd": _minimum_distance, "naive": _naive, "passthrough": _passthrough}


def register_decoder(name: str, builder: Builder) -> None:
    """Add an algorithm. builder gets the reads with columns _raw and _raw_quality (and _s0, _t0, ... for each segment), the decoder, the observed columns, the Phred offset and the limit of unrolling; it returns the reads and the result struct."""
    _ALGORITHMS[name] = builder


def algorithms() -> tuple[str, ...]:
    return tuple(_ALGORITHMS)


def decode(df: DataFrame, decoder: Decoder, source: dict[str, tuple[Column, Column]], offset: int = sequences.PHRED_OFFSET, unrolled: int = 0) -> DataFrame:
    """df with the decoder's struct column. source: sequence and quality columns of the input segments by number."""
    if decoder.algorithm not in _ALGORITHMS:
        raise tokens.PlanError(f"unknown decoder algorithm {decoder.algorithm!r}")
    columns = df.columns
    observed = tokens.apply(decoder.transform, source)
    if observed:
        df = df.withColumns({f"_s{i}": s for i, (s, _) in enumerate(observed)} | {f"_t{i}": q for i, (_, q) in enumerate(observed)})
        df = df.withColumns(_joined(decoder, len(observed), offset))
    df, result = _ALGORITHMS[decoder.algorithm](df, decoder, observed, offset, unrolled)
    return df.withColumn(decoder.column, result).select(*columns, decoder.column)


def decode_all(df: DataFrame, decoders: list[Decoder], source: dict[str, tuple[Column, Column]], qcfail: str = "qcfail", offset: int = sequences.PHRED_OFFSET, unrolled: int = 0) -> DataFrame:
    """Apply decoders in order. A read that one fails is failed for those that follow; each adds `<column>_qcfail`, the state that its counts see, and the last one's state replaces `qcfail`."""
    state = F.col(qcfail)
    for decoder in decoders:
        df = decode(df, decoder, source, offset, unrolled)
        df = df.withColumn(f"{decoder.column}_qcfail", state | F.col(f"{decoder.column}.fail"))
        state = F.col(f"{decoder.column}_qcfail")
    return df.withColumn(qcfail, state)
