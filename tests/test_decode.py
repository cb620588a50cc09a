"""Decoders against a plain scalar version."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.functions.tokens import PlanError, Transform
from readloom.operators import decode, metrics
from readloom.operators.decode import Barcode, Decoder
from readloom.plans import synthetic as syn

UNIFORM = 10 * math.log10(4)


def cost(expected, observed, q):
    if observed == "" or q <= 0:
        return 0.0
    if expected not in "ACGT" or observed not in "ACGT":
        return UNIFORM
    return -10 * math.log10(1 - 10 ** (-q / 10)) if expected == observed else float(q)


def likelihood(seq, qual, d: Decoder):
    width = len(d.barcodes[0].flat)
    q = [ord(c) - 33 for c in qual]
    best, top, total, distance, high = 0, 0.0, 0.0, 0, 0
    for i, b in enumerate(d.barcodes):
        pairs = [(e, seq[j : j + 1], q[j] if j < len(q) else 0) for j, e in enumerate(b.flat)]
        conditional = 10 ** (-sum(cost(*p) for p in pairs) / 10)
        joint = conditional * b.concentration
        total += joint
        if joint > top:
            best, top, kept = i + 1, joint, conditional
            distance = sum(e != o for e, o, _ in pairs)
            high = sum(e != o and x >= d.high_quality_threshold for e, o, x in pairs)
    if not best:
        return 0, 0, 0.0, "", True
    posterior = top / (total + d.noise * 0.25**width)
    if kept <= 0.25**width:
        return 0, 0, 0.0, "conditional", True
    bad = 0 < d.high_quality_distance_threshold <= high
    return best, distance, posterior, "confidence" if posterior <= d.confidence_threshold else "", bad or posterior <= d.confidence_threshold


def observations(n, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        word = list(rng.choice(syn.WORDS))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            word[rng.randrange(8)] = rng.choice("ACGTNR")
        seq = "".join(word)[: rng.choice([8, 8, 8, 8, 6, 0, 7])]
        out.append((seq, "".join(chr(33 + rng.choice([0, 2, 10, 20, 30, 37, 41])) for _ in seq)))
    return out


def reads(spark, rows):
    return spark.createDataFrame([(i, False, s, q) for i, (s, q) in enumerate(rows)], "read_index long, qcfail boolean, s1_seq string, s1_qual string")


def source():
    return {"1": (F.col("s1_seq"), F.col("s1_qual"))}


@pytest.mark.parametrize("unrolled", [0, 10_000])
def test_likelihood(spark, unrolled):
    rows = observations(600)
    decoder = syn.sample_decoder()
    out = decode.decode(reads(spark, rows), decoder, source(), unrolled=unrolled).select("read_index", "sample_0.*").collect()
    for r in out:
        index, distance, posterior, low, fail = likelihood(*rows[r["read_index"]], decoder)
        assert (r["barcode_index"], r["distance"], r["low"], r["fail"]) == (index, distance, low, fail), rows[r["read_index"]]
        assert r["confidence"] == pytest.approx(posterior, rel=1e-9)


def test_likelihoods_to_the_last_bit():
    """Costs are added from the first base, joint likelihoods from the largest, one by one, whatever reads are scored together."""
    decoder = syn.sample_decoder()
    rows = [(s, q) for s, q in observations(400) if len(s) == 8]
    letters = lambda texts: np.array([list(t.encode()) for t in texts], np.uint8)
    raw, quality, words = letters(s for s, _ in rows), letters(q for _, q in rows).astype(np.int64) - 33, letters(b.flat for b in decoder.barcodes)
    floor = decoder.noise * decoder.random
    score = lambda some: decode.score_batch(raw[some], quality[some], words, np.array([b.concentration for b in decoder.barcodes]), floor, 30)
    got = score(slice(None))
    for i, (s, q) in enumerate(rows):
        joint = []
        for b in decoder.barcodes:
            phred = 0.0
            for e, o, x in zip(b.flat, s, quality[i].tolist(), strict=True):
                phred += cost(e, o, x)
            joint.append(math.pow(10.0, phred / -10.0) * b.concentration)
        total = 0.0
        for x in sorted(joint, reverse=True):
            total += x
        assert got["confidence"][i] == max(joint) / (total + floor), (s, q)
    for at in (0, 7, len(rows) - 1):
        assert score(slice(at, at + 1))["confidence"][0] == got["confidence"][at]


def test_ambiguous_barcode_base(spark):
    codec = (Barcode("a", ("ACNT",), 0.5), Barcode("b", ("GGGG",), 0.49))
    decoder = Decoder("sample", "pamld", Transform.parse({"token": ["1::4"]}), codec, noise=0.01)
    rows = [("ACGT", "IIII"), ("ACNT", "IIII"), ("GGGG", "IIII")]
    for unrolled in (0, 1000):
        out = decode.decode(reads(spark, rows), decoder, source(), unrolled=unrolled).orderBy("read_index").select("sample_0.*").collect()
        assert [r["barcode_index"] for r in out] == [1, 1, 2]
        assert out[0]["confidence"] == pytest.approx(likelihood(*rows[0], decoder)[2])


def nearest(seq, qual, d: Decoder):
    for i, b in enumerate(d.barcodes):
        if b.flat == seq:
            return i + 1, 0
    for i, b in enumerate(d.barcodes):
        apart = sum(o != e or (d.quality_masking_threshold > 0 and ord(q) - 33 < d.quality_masking_threshold) for o, e, q in zip(seq, b.flat, qual, strict=False))
        if apart <= d.tolerance[0]:
            return i + 1, apart
    return 0, 0


@pytest.mark.parametrize("mask", [0, 15])
@pytest.mark.parametrize("unrolled", [0, 10_000])
def test_minimum_distance(spark, mask, unrolled):
    rows = observations(400, seed=9)
    decoder = syn.sample_decoder("mdd", quality_masking_threshold=mask)
    assert decoder.tolerance == (2,)
    out = decode.decode(reads(spark, rows), decoder, source(), unrolled=unrolled).select("read_index", "sample_0.*").collect()
    for r in out:
        index, distance = nearest(*rows[r["read_index"]], decoder)
        assert (r["barcode_index"], r["distance"], r["fail"]) == (index, distance, index == 0), rows[r["read_index"]]


def test_chain_and_registry(spark):
    rows = [("GCCTGATT", "IIIIIIII"), ("NNNNNNNN", "########")]
    first, second = syn.sample_decoder(), replace(syn.sample_decoder("mdd"), topic="cellular", multiplexing=False)
    out = decode.decode_all(reads(spark, rows), [first, second], source()).orderBy("read_index").collect()
    assert [(r["sample_0_qcfail"], r["cellular_0_qcfail"], r["qcfail"]) for r in out] == [(False, False, False), (True, True, True)]
    decode.register_decoder("first", lambda df, d, observed, offset, unrolled: (df, decode._result(barcode_index=F.lit(1))))
    assert decode.decode(reads(spark, rows), replace(first, algorithm="first"), source()).select("sample_0.barcode_index").first()[0] == 1
    with pytest.raises(PlanError):
        decode.decode(reads(spark, rows), replace(first, algorithm="none"), source())


def test_filter_on_results_stays_above_the_kernel(spark):
    plan = decode.decode(reads(spark, observations(5)), syn.sample_decoder(), source()).where("sample_0.low = 'conditional'")
    assert plan._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_metrics(spark):
    words = [("AAAA", "CC"), ("AATT", "CG"), ("TTTT", "CC")]
    assert metrics.minimum_distances(words) == (2, 1)
    assert metrics.shannon_bounds([("AAAAA",), ("TTTTT",)]) == (2,)
    assert metrics.shannon_bound(1) == 0
    matrix = {(r["segment"], r["i"], r["j"]): (r["distance"], r["bound"]) for r in metrics.distance_matrix(metrics.codec_frame(spark, words), 4).collect()}
    assert matrix[0, 1, 3] == (4, 1) and matrix[0, 1, 2] == (2, 0) and matrix[1, 1, 2][0] == 1


def test_a_very_large_codec():
    """100,000 barcodes: exact and nearest matches and likelihoods in bounded memory, minimum distance without all pairs."""
    import resource

    from readloom.operators import metrics

    rng = np.random.default_rng(3)
    letters = np.frombuffer(b"ACGT", np.uint8)
    words = np.unique(letters[rng.integers(0, 4, (100_000, 16))], axis=0)
    picked = rng.integers(0, len(words), 300)
    raw = words[picked].copy()
    raw[::3, 5] = letters[(np.searchsorted(letters, raw[::3, 5]) + 1) % 4]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    index, distance = decode.nearest([raw], [words], (1,))
    assert ((index - 1 == picked) | (distance <= 1)).all() and (index > 0).all()
    got = decode.score_batch(raw, np.full(raw.shape, 30), words, np.full(len(words), 0.99 / len(words)), 0.01 * 0.25**16, 30)
    assert (got["best"] > 0).all() and (got["best"] - 1 == picked)[1::3].all()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000
    few = [bytes(w).decode() for w in words[:400]]
    plain = min(metrics.hamming(a, b) for i, a in enumerate(few) for b in few[:i])
    assert metrics.minimum_distances([(w,) for w in few]) == (plain,)
    assert metrics.minimum_distances([(bytes(w).decode(),) for w in words])[0] in (1, 2)
