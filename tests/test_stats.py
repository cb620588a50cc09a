import random

import pytest
from pyspark.sql import functions as F

from readloom.functions.tokens import Transform
from readloom.operators import assemble, stats
from readloom.operators.decode import decode_all
from readloom.plans import report
from readloom.plans import synthetic as syn


@pytest.fixture(scope="module")
def decoded(spark, sf_dir):
    return decode_all(syn.reads(spark, sf_dir), syn.decoders(), syn.source()).persist()


def test_report(decoded):
    decoders = syn.decoders()
    reports = stats.decoder_reports(stats.barcode_counts(decoded, decoders), decoders)
    rows = decoded.select("sample_0.*", "sample_0_qcfail", "cellular_0_qcfail", F.col("cellular_0.barcode_index").alias("cell")).collect()
    sample, molecular, cellular = reports
    assert sample.count == molecular.count == cellular.count == len(rows)
    for i in range(17):
        mine = [r for r in rows if r["barcode_index"] == i]
        assert sample.by_index[i].count == len(mine)
        assert sample.by_index[i].pf_count == sum(not r["sample_0_qcfail"] for r in mine)
        assert sample.by_index[i].low_conditional == sum(r["best_index"] == i and r["low"] == "conditional" for r in rows)
        assert sample.by_index[i].confidence == pytest.approx(sum(r["confidence"] for r in mine if i and not r["low"]))
        assert cellular.by_index[i].pf_count == sum(r["cell"] == i and not r["cellular_0_qcfail"] for r in rows)
    low = sum(r["low"] == "conditional" for r in rows)
    unsure = sum(r["low"] == "confidence" for r in rows)
    passed = sum(r["barcode_index"] > 0 and not r["sample_0_qcfail"] for r in rows)
    assert sample.estimated_noise == pytest.approx((low + unsure * low / (low + passed)) / len(rows))
    assert sum(sample.estimated_concentration(i) for i in range(1, 17)) == pytest.approx(1 - sample.estimated_noise)
    document = report.decoder_document(sample)
    assert len(document["classified"]) == 16 and document["classified"][0]["BC"] == syn.WORDS[0]
    assert "low conditional confidence count" not in report.decoder_document(cellular)
    assert molecular.totals()["classified count"] == 0


def test_adjusted_priors():
    job = {"decoder": {"base": {"codec": {"@A": {"barcode": ["A"]}, "@C": {"barcode": ["C"], "concentration": 3}}}}, "sample": {"base": "base", "noise": 0.1}}
    found = {"sample": {"estimated noise": 0.25, "classified": [{"barcode": ["A"], "estimated concentration": 0.75}, {"barcode": ["C"]}]}}
    out = report.adjust_priors(job, found)
    assert out["sample"]["noise"] == 0.25
    assert out["sample"]["codec"]["@A"]["concentration"] == 0.75 and out["sample"]["codec"]["@C"]["concentration"] == 0
    assert job["sample"]["noise"] == 0.1


def test_histogram_stats(spark):
    values = {"a": [0, 0, 5, 7, 7, 9, 40], "b": [3], "c": [0, 0]}
    rows = [(k, q, v.count(q)) for k, v in values.items() for q in set(v)]
    out = {r["key"]: r for r in stats.histogram_stats(spark.createDataFrame(rows, "key string, quality int, n long"), ["key"]).collect()}
    for k, v in values.items():
        v = sorted(v)
        quantile = lambda p, v=v: v[int(p * len(v)) - 1] if int(p * len(v)) else 0
        r = out[k]
        assert (r["count"], r["sum_quality"], r["max_quality"]) == (len(v), sum(v), max(v))
        assert (r["q1"], r["median_quality"], r["q3"]) == (quantile(0.25), quantile(0.5), quantile(0.75))
        assert r["min_quality"] == min([q for q in v if q] or [0])


def test_quality_is_held_to_the_bins(spark):
    df = spark.createDataFrame([("AC", "!~")], "s string, q string")
    assert [r["quality"] for r in stats.bases_with_quality(df, F.col("s"), F.col("q"), []).orderBy("cycle").collect()] == [0, 41]


def test_average_quality(spark):
    df = spark.createDataFrame([("",), (None,), ("!I",)], "q string")
    assert [r[0] for r in df.select(stats.average_quality(F.col("q"))).collect()] == [None, None, 20.0]


@pytest.mark.parametrize("value", [1.29412e-06, 0.5, 0.123456789, 1e-4, 9.99999e-5, 1.0, 12.5, 123456.7, 1234567.0, 0.00012345678, 3e-10])
def test_short_float(spark, value):
    assert spark.range(1).select(assemble.short_float(F.lit(value))).first()[0] == (f"{value:g}" if value > 0 else "")


def test_flags_and_corrected(spark, decoded):
    out = assemble.assemble(decoded, Transform.parse({"token": ["0::", "s::", "c::4"]}), syn.decoders(), syn.source(), ["read_index"])
    r = out.join(decoded.select("read_index", "sample_0", "qcfail"), "read_index").first()
    assert [s["flag"] & ~512 for s in r["segments"]] == [77, 13, 141]
    word = syn.WORDS[r["sample_0"]["barcode_index"] - 1] if r["sample_0"]["barcode_index"] else "========"
    assert r["segments"][1]["seq"] == word[: len(r["sample_0"]["raw"])]
    three = assemble.records(out).where("segment = 2").select(assemble.tag_text("tags", F.col("segment"), F.col("total"))).first()[0]
    assert three.startswith("FI:i:2\tTC:i:3\tRG:Z:")


def test_base_counts_against_a_row_per_base(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 3), "".join(rng.choice("ACGTN") for _ in range(n)), "".join(chr(rng.randint(33, 80)) for _ in range(max(0, n - rng.randint(0, 1))))) for n in [rng.randint(0, 30) for _ in range(400)]] + [(1, None, None)]
    df = spark.createDataFrame(rows, "k int, s string, q string")
    flat = stats.bases_with_quality(df, F.col("s"), F.col("q"), ["k"]).groupBy("k", "cycle", "base", "quality").count()
    counted = stats.base_counts(df, F.col("s"), F.col("q"), ["k"]).groupBy("k", "cycle", "base", "quality").agg(F.sum("n"))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, flat.collect()))
    assert stats.base_counts(df.limit(0), F.col("s"), F.col("q"), []).count() == 0
