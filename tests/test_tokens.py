import pytest
from pyspark.sql import functions as F

from readloom.functions import sequences, tokens
from readloom.functions.tokens import PlanError, Token, Transform


@pytest.mark.parametrize(
    ("text", "width"),
    [("0::8", 8), ("1:2:10", 8), ("0:-5:", 5), ("0:-5:-2", 3), ("0::", None), ("2:3:", None), ("0:3:-1", None), ("s::", None), ("0:-5:3", None), ("0:4:2", 0)],
)
def test_width(text, width):
    assert Token.parse(text).width == width


@pytest.mark.parametrize("text", ["", "0", "0:", "x::", "0:a:", "0::8:", "-1::"])
def test_illegal_tokens(text):
    with pytest.raises(PlanError):
        Token.parse(text)


def reference_slice(value: str, start: int | None, end: int | None) -> str:
    n = len(value)
    low = 0 if start is None else max(0, n + start) if start < 0 else 0 if start > n else start
    high = n if end is None else max(0, n + end) if end < 0 else min(end, n)
    return value[low:high] if high > low else ""


def test_slices(spark):
    values = ["", "A", "ACGTACGT", "ACGTACGTACGTACGTACGT"]
    bounds = [(s, e) for s in (None, 0, 3, 8, 9, 30, -1, -4, -30) for e in (None, 0, 3, 8, 30, -1, -4, -30)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select("v", *[sequences.slice_column(F.col("v"), s, e).alias(f"c{i}") for i, (s, e) in enumerate(bounds)]).collect()
    for r in rows:
        for i, (s, e) in enumerate(bounds):
            assert r[f"c{i}"] == reference_slice(r["v"], s, e), (r["v"], s, e)


def test_knit_and_complement(spark):
    df = spark.createDataFrame([("ACMGRSVTWYHKDBN", "0123456789abcde")], "s string, q string")
    transform = Transform.parse({"token": ["0::4", "0:-3:"], "knit": ["~1:0", "0"]})
    source = {"0": (F.col("s"), F.col("q"))}
    (a, qa), (b, qb) = tokens.apply(transform, source)
    assert df.select(a, qa, b, qb).first()[:] == ("NVHACMG", "edc0123", "ACMG", "0123")
    assert transform.widths() == (7, 4)
    twice = df.select(sequences.reverse_complement(sequences.reverse_complement(F.col("s")))).first()[0]
    assert twice == "ACMGRSVTWYHKDBN"
    with pytest.raises(PlanError):
        Transform.parse({"token": ["0::4"], "knit": ["1"]})
    with pytest.raises(PlanError):
        Transform.parse({"token": ["0::"]}).widths()


def test_normalise_and_strict(spark):
    df = spark.createDataFrame([("acgtu0123.X=r",), ("ACGT",), ("",)], "s string")
    rows = df.select(sequences.normalise(F.col("s")), sequences.is_strict(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [("ACGTNACGTNN=R", False), ("ACGT", True), ("", True)]


def test_expected_error(spark):
    quals = ["", "I", "!5?I"]
    df = spark.createDataFrame([(q,) for q in quals], "q string")
    got = [r[0] for r in df.select(sequences.expected_error(F.col("q"), 6)).collect()]
    assert got == pytest.approx([sum(10 ** (-(ord(c) - 33) / 10) for c in q) for q in quals])
