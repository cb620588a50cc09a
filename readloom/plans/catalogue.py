"""The query catalogue: one query per operator over synthetic reads, each with the same result in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import sequences as sq
from readloom.functions import tokens
from readloom.functions.tokens import Transform
from readloom.operators import assemble, decode, metrics, stats
from readloom.plans import synthetic as syn

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | Callable[[], str]) -> Callable[[Query], Query]:
    """Register a query under its name with the SQL that gives the same rows."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        SQL[function.__name__] = sql if isinstance(sql, str) else sql()
        return function

    return register


READS = syn.sql_reads()

# ---------------------------------------------------------------- SQL fragments

_LUT = "[" + ", ".join(f"{x!r}::DOUBLE" for x in sq.MATCH_COSTS[:64]) + "]"
_CODEC = "codec(barcode_index, word, concentration) AS (VALUES " + ", ".join(f"({i + 1}, '{w}', {c!r}::DOUBLE)" for i, (w, c) in enumerate(zip(syn.WORDS, syn.CONCENTRATIONS, strict=True))) + ")"
_RANDOM = 0.25**8


def _o(j: int, seq: str = "s1_seq") -> str:
    return f"substring({seq}, {j + 1}, 1)"


def _q(j: int, qual: str = "s1_qual") -> str:
    return f"(ascii(substring({qual}, {j + 1}, 1)) - 33)"


def _sum(terms) -> str:
    return "(" + " + ".join(terms) + ")"


def _sigma(width: int = 8, seq: str = "s1_seq", qual: str = "s1_qual", word: str = "word") -> str:
    def cost(j: int) -> str:
        o, q, e = _o(j, seq), _q(j, qual), f"substring({word}, {j + 1}, 1)"
        return f"CASE WHEN length({seq}) <= {j} OR {q} <= 0 THEN 0.0::DOUBLE WHEN {o} NOT IN ('A','C','G','T') THEN {sq.UNIFORM_COST!r}::DOUBLE WHEN {o} = {e} THEN {_LUT}[{q} + 1] ELSE {q}::DOUBLE END"

    return _sum(cost(j) for j in range(width))


def _apart(width: int = 8, seq: str = "s1_seq", word: str = "word") -> str:
    return _sum(f"CASE WHEN {_o(j, seq)} = substring({word}, {j + 1}, 1) THEN 0 ELSE 1 END" for j in range(width))


def _apart_observed(mask: int = 0, width: int = 8, seq: str = "s1_seq", qual: str = "s1_qual", word: str = "word") -> str:
    low = lambda j: f" OR {_q(j, qual)} < {mask}" if mask else ""
    return _sum(f"CASE WHEN length({seq}) > {j} AND ({_o(j, seq)} <> substring({word}, {j + 1}, 1){low(j)}) THEN 1 ELSE 0 END" for j in range(width))


def _high() -> str:
    return _sum(f"CASE WHEN length(s1_seq) > {j} AND {_o(j)} <> substring(word, {j + 1}, 1) AND {_q(j)} >= {syn.HIGH} THEN 1 ELSE 0 END" for j in range(8))


def _likelihood(concentration: str = "concentration", noise: str = repr(syn.NOISE), name: str = "decoded", codec: str = "codec") -> str:
    """decoded: the sample decoder's result by likelihood, a row per read."""
    return f"""scored_{name} AS (SELECT read_index, barcode_index, pow(10.0::DOUBLE, {_sigma()} / -10.0::DOUBLE) AS conditional, {concentration} AS prior, {_apart()} AS distance, {_high()} AS high FROM reads, {codec}),
ranked_{name} AS (SELECT *, row_number() OVER (PARTITION BY read_index ORDER BY conditional * prior DESC, barcode_index) AS place, sum(conditional * prior) OVER (PARTITION BY read_index) AS joint FROM scored_{name}),
best_{name} AS (SELECT read_index, barcode_index AS best_index, conditional, distance, high, conditional * prior / (joint + {noise} * {_RANDOM!r}::DOUBLE) AS posterior FROM ranked_{name} WHERE place = 1),
{name} AS (SELECT r.*, best_index, conditional, high AS high_quality_distance, posterior,
  CASE WHEN conditional > {_RANDOM!r} THEN best_index ELSE 0 END AS barcode_index,
  CASE WHEN conditional > {_RANDOM!r} THEN distance ELSE 0 END AS distance,
  CASE WHEN conditional > {_RANDOM!r} THEN posterior ELSE 0.0::DOUBLE END AS confidence,
  CASE WHEN conditional <= {_RANDOM!r} THEN 'conditional' WHEN posterior <= {syn.THRESHOLD} THEN 'confidence' ELSE '' END AS low,
  (conditional <= {_RANDOM!r} OR posterior <= {syn.THRESHOLD} OR high >= {syn.HIGH_DISTANCE}) AS fail
  FROM reads r JOIN best_{name} USING (read_index))"""


def _nearest(mask: int = 0, seq: str = "s1_seq", qual: str = "s1_qual", name: str = "near") -> str:
    """near: the minimum distance decoder's class and distance; tolerance 2."""
    return f"""apart_{name} AS (SELECT read_index, barcode_index, word = {f"substring({seq}, 1, 8)"} AS exact, {_apart_observed(mask, seq=seq, qual=qual)} AS distance FROM reads, codec),
held_{name} AS (SELECT *, row_number() OVER (PARTITION BY read_index ORDER BY exact DESC, barcode_index) AS place FROM apart_{name} WHERE exact OR distance <= 2),
{name} AS (SELECT r.read_index, coalesce(barcode_index, 0) AS barcode_index, CASE WHEN exact THEN 0 ELSE coalesce(distance, 0) END AS distance FROM reads r LEFT JOIN (SELECT * FROM held_{name} WHERE place = 1) USING (read_index))"""


DECODED = f"{READS}, {_CODEC}, {_likelihood()}"


def _int(c: str) -> Column:
    return F.col(c).cast("long").alias(c.rpartition(".")[2])


def _decoded(spark: SparkSession, sf_dir: str, **changes) -> DataFrame:
    return decode.decode_all(syn.reads(spark, sf_dir), [syn.sample_decoder(**changes)], syn.source())


# ---------------------------------------------------------------- projections


def _slice_sql(value: str, start: int | None, end: int | None) -> str:
    n = f"length({value})"
    low = "0" if start is None else f"greatest({n} + {start}, 0)" if start < 0 else f"CASE WHEN {start} > {n} THEN 0 ELSE {start} END"
    high = n if end is None else f"greatest({n} + {end}, 0)" if end < 0 else f"least({end}, {n})"
    return f"substring({value}, ({low}) + 1, greatest(({high}) - ({low}), 0))"


_SLICES = {"whole": "2::", "front": "0:2:10", "tail": "2:-5:", "trimmed": "2::-3", "behind": "2:20:60", "beyond": "2:25:30", "both": "2:-9:-4"}


@query(lambda: f"{READS} SELECT read_index, " + ", ".join(f"{_slice_sql(f's{t.segment}_seq', t.start, t.end)} AS {k}" for k, v in _SLICES.items() for t in [tokens.Token.parse(v)]) + " FROM reads")
def token_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = {k: tokens.apply(Transform.parse({"token": [v]}), syn.source())[0][0] for k, v in _SLICES.items()}
    return syn.reads(spark, sf_dir).select("read_index", *[c.alias(k) for k, c in cut.items()])


_COMPLEMENT = f"'{sq.COMPLEMENT[0]}', '{sq.COMPLEMENT[1]}'"


@query(f"{READS} SELECT read_index, reverse(translate(s1_seq, {_COMPLEMENT})) AS seq, reverse(s1_qual) AS qual FROM reads")
def token_revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    ((s, q),) = tokens.apply(Transform.parse({"token": ["1::"], "knit": ["~0"]}), syn.source())
    return syn.reads(spark, sf_dir).select("read_index", s.alias("seq"), q.alias("qual"))


@query(f"{READS} SELECT read_index, concat(substring(s1_seq, 1, 8), reverse(translate(substring(s0_seq, 1, 6), {_COMPLEMENT}))) AS seq, concat(substring(s1_qual, 1, 8), reverse(substring(s0_qual, 1, 6))) AS qual FROM reads")
def knit_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    ((s, q),) = tokens.apply(Transform.parse({"token": ["1::8", "0::6"], "knit": ["0:~1"]}), syn.source())
    return syn.reads(spark, sf_dir).select("read_index", s.alias("seq"), q.alias("qual"))


_TEMPLATE = {"token": ["0:8:", "2::", "1::8"], "knit": ["0", "2:1"]}


@query(
    f"""{READS}, cut AS (SELECT read_index, qcfail, substring(s0_seq, 9) AS a, substring(s0_qual, 9) AS qa, concat(substring(s1_seq, 1, 8), s2_seq) AS b, concat(substring(s1_qual, 1, 8), s2_qual) AS qb FROM reads)
SELECT read_index, 1 AS segment, CASE WHEN qcfail THEN 589 ELSE 77 END AS flag, a AS seq, qa AS qual FROM cut
UNION ALL SELECT read_index, 2, CASE WHEN qcfail THEN 653 ELSE 141 END, b, qb FROM cut"""
)
def template_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = assemble.assemble(syn.reads(spark, sf_dir), Transform.parse(_TEMPLATE), [], syn.source(), ["read_index"])
    return assemble.records(made).select("read_index", "segment", "flag", "seq", "qual")


@query(f"{READS} SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(s1_seq, '^[ACGT]*$')) AS strict_n, sum(CASE WHEN regexp_matches(s1_seq, '^[ACGT]*$') THEN length(s1_seq) ELSE 0 END)::BIGINT AS strict_bases FROM reads")
def strict_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    strict = sq.is_strict(F.col("s1_seq"))
    return syn.reads(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(strict).alias("strict_n"), F.sum(F.when(strict, F.length("s1_seq")).otherwise(0)).cast("long").alias("strict_bases"))


@query(f"{READS} SELECT read_index, regexp_replace(translate(upper(concat(lower(s1_seq), '0123.uRX')), '0123', 'ACGT'), '[^{sq.IUPAC}]', 'N', 'g') AS seq FROM reads")
def normalise_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syn.reads(spark, sf_dir).select("read_index", sq.normalise(F.concat(F.lower("s1_seq"), F.lit("0123.uRX"))).alias("seq"))


@query(f"{READS} SELECT read_index, round({_sum(f'CASE WHEN length(s2_qual) > {j} THEN pow(10.0::DOUBLE, -{_q(j, 's2_qual')} / 10.0::DOUBLE) ELSE 0.0 END' for j in range(51))}, 6) AS expected_error FROM reads")
def expected_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syn.reads(spark, sf_dir).select("read_index", F.round(sq.expected_error(F.col("s2_qual"), 51), 6).alias("expected_error"))


@query("SELECT q AS quality, chr((q + 33)::INT) AS symbol, round(pow(10.0::DOUBLE, -q / 10.0), 9) AS error_probability, CASE WHEN q > 0 THEN round(-10 * log10(1 - pow(10.0::DOUBLE, -q / 10.0)), 9) ELSE 0.0 END AS match_cost FROM (SELECT unnest(generate_series(0, 41)) AS q)")
def phred_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("id")
    error = F.pow(F.lit(10.0), -q / 10.0)
    cost = F.element_at(F.array(*[F.lit(c) for c in sq.MATCH_COSTS[: sq.PHRED_BINS]]), (q + 1).cast("int"))
    return spark.range(sq.PHRED_BINS).select(q.alias("quality"), F.chr(q + sq.PHRED_OFFSET).alias("symbol"), F.round(error, 9).alias("error_probability"), F.round(cost, 9).alias("match_cost"))


# ---------------------------------------------------------------- zip, interleave, comments, filters


def _segment_frame(reads: DataFrame, i: int) -> DataFrame:
    return reads.select("read_index", F.col("name").alias(f"name{i}"), F.col(f"s{i}_seq").alias(f"seq{i}"))


@query(f"{READS} SELECT read_index, name, s0_seq AS seq0, s1_seq AS seq1, s2_seq AS seq2 FROM reads WHERE read_index < (SELECT max(read_index) - 4 FROM reads)")
def segment_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of segments joined by place; the shortest one ends the reads, and all names of a read must agree."""
    reads = syn.reads(spark, sf_dir)
    last = reads.agg(F.max("read_index").alias("last"))
    short = _segment_frame(reads, 2).crossJoin(F.broadcast(last)).where(F.col("read_index") < F.col("last") - 4).drop("last")
    zipped = _segment_frame(reads, 0).join(_segment_frame(reads, 1), "read_index").join(short, "read_index")
    same = (F.col("name0") == F.col("name1")) & (F.col("name0") == F.col("name2"))
    name = F.when(same, F.col("name0")).otherwise(F.raise_error(F.concat(F.lit("segments out of step: "), F.col("name0"))).cast("string"))
    return zipped.select("read_index", name.alias("name"), "seq0", "seq1", "seq2")


@query(f"{READS} SELECT read_index, s0_seq AS seq0, s0_qual AS qual0, s1_seq AS seq1, s1_qual AS qual1 FROM reads")
def interleave_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of an interleaved file regrouped into reads of two segments by their place."""
    reads = syn.reads(spark, sf_dir)
    pair = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"s{i}_seq").alias("seq"), F.col(f"s{i}_qual").alias("qual")) for i in range(2)])
    flat = reads.select("read_index", F.explode(pair).alias("s")).select((F.col("read_index") * 2 + F.col("s.i")).alias("record"), "s.seq", "s.qual")
    read, segment = F.expr("record div 2"), F.col("record") % 2
    pick = lambda c, i: F.max(F.when(F.col("segment") == i, F.col(c))).alias(f"{c}{i}")
    return flat.select(read.alias("read_index"), segment.alias("segment"), "seq", "qual").groupBy("read_index").agg(*[pick(c, i) for i in range(2) for c in ("seq", "qual")])


@query(
    f"""{READS}, said AS (SELECT read_index, CASE WHEN qcfail THEN concat('2:Y:', cast(read_index % 5 as string), ':', s1_seq) ELSE concat('x:N:0:', s1_seq) END AS comment FROM reads)
SELECT read_index, CASE WHEN regexp_matches(split_part(comment, ':', 1), '^[0-9]+$') THEN split_part(comment, ':', 1)::INT ELSE 1 END AS segment, split_part(comment, ':', 2) = 'Y' AS qcfail, split_part(comment, ':', 3)::INT AS control, split_part(comment, ':', 4) AS barcode FROM said"""
)
def comment_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.sources.fastq import parse_comment

    said = F.when(F.col("qcfail"), F.concat(F.lit("2:Y:"), (F.col("read_index") % 5).cast("string"), F.lit(":"), F.col("s1_seq"))).otherwise(F.concat(F.lit("x:N:0:"), F.col("s1_seq")))
    return syn.reads(spark, sf_dir).select("read_index", said.alias("comment")).select("read_index", parse_comment(F.col("comment")).alias("c")).select("read_index", "c.segment", "c.qcfail", "c.control", "c.barcode")


@query(f"{READS} SELECT count(*) AS count, count(*) FILTER (WHERE NOT qcfail) AS pf_count, sum(length(s0_seq) + length(s1_seq) + length(s2_seq))::BIGINT AS bases FROM reads WHERE NOT qcfail")
def filter_incoming_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = syn.reads(spark, sf_dir).where(~F.col("qcfail"))
    return kept.agg(F.count("*").alias("count"), F.count_if(~F.col("qcfail")).alias("pf_count"), F.sum(F.length("s0_seq") + F.length("s1_seq") + F.length("s2_seq")).cast("long").alias("bases"))


@query(f"{READS} SELECT read_index, length(s1_seq)::BIGINT AS length1, length(s2_seq)::BIGINT AS length2 FROM reads WHERE length(s1_seq) >= 8 AND length(s2_seq) >= {syn.LEAST_LENGTH}")
def filter_min_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readloom.plans.engine import long_enough

    kept = syn.reads(spark, sf_dir).where(long_enough([60, 8, syn.LEAST_LENGTH], syn.source()))  # the first segment is never held to a length
    return kept.select("read_index", F.length("s1_seq").cast("long").alias("length1"), F.length("s2_seq").cast("long").alias("length2"))


@query(f"{DECODED} SELECT barcode_index, count(*) AS count, count(*) FILTER (WHERE NOT (qcfail OR fail)) AS written FROM decoded GROUP BY 1")
def filter_outgoing_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed reads are counted but not written."""
    channel = F.col("sample_0.barcode_index").alias("barcode_index")
    return _decoded(spark, sf_dir).groupBy(channel).agg(F.count("*").alias("count"), F.count_if(~F.col("qcfail")).alias("written"))


# ---------------------------------------------------------------- distance decoders


@query(f"{READS}, {_CODEC}, apart AS (SELECT read_index, min({_apart()}) AS distance FROM reads, codec GROUP BY 1) SELECT distance, count(*) AS n FROM apart GROUP BY 1")
def hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = F.least(*[sq.hamming(F.col("s1_seq"), w) for w in syn.WORDS])
    return syn.reads(spark, sf_dir).groupBy(least.alias("distance")).agg(F.count("*").alias("n"))


@query(f"{READS}, {_CODEC} SELECT coalesce(barcode_index, 0) AS barcode_index, count(*) AS n, count(*) FILTER (WHERE NOT qcfail) AS pf_n FROM reads LEFT JOIN codec ON substring(s1_seq, 1, 8) = word GROUP BY 1")
def mdd_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches only, as a broadcast hash join against the codec (bounded by the job document)."""
    codec = spark.createDataFrame([(i + 1, w) for i, w in enumerate(syn.WORDS)], "barcode_index int, word string")
    reads = syn.reads(spark, sf_dir).withColumn("word", F.substring("s1_seq", 1, 8))
    return reads.join(F.broadcast(codec), "word", "left").groupBy(F.coalesce("barcode_index", F.lit(0)).alias("barcode_index")).agg(F.count("*").alias("n"), F.count_if(~F.col("qcfail")).alias("pf_n"))


def _nearest_result(df: DataFrame) -> DataFrame:
    return df.select("read_index", _int("sample_0.barcode_index"), _int("sample_0.distance"))


@query(f"{READS}, {_CODEC}, {_nearest()} SELECT read_index, barcode_index::BIGINT AS barcode_index, distance::BIGINT AS distance FROM near")
def mdd_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest_result(_decoded(spark, sf_dir, algorithm="mdd", distance_tolerance=(2,)))


@query(f"{READS}, {_CODEC}, {_nearest(syn.MASK)} SELECT read_index, barcode_index::BIGINT AS barcode_index, distance::BIGINT AS distance FROM near")
def mdd_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest_result(_decoded(spark, sf_dir, algorithm="mdd", distance_tolerance=(2,), quality_masking_threshold=syn.MASK))


# ---------------------------------------------------------------- likelihood decoder


@query(f"{DECODED} SELECT read_index, best_index::BIGINT AS best_index, round(conditional, 9) AS conditional FROM decoded")
def pamld_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir).select("read_index", _int("sample_0.best_index"), F.round("sample_0.conditional", 9).alias("conditional"))


@query(f"{DECODED} SELECT read_index, barcode_index::BIGINT AS barcode_index, distance::BIGINT AS distance, round(confidence, 6) AS confidence FROM decoded")
def pamld_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir).select("read_index", _int("sample_0.barcode_index"), _int("sample_0.distance"), F.round("sample_0.confidence", 6).alias("confidence"))


@query(f"{DECODED} SELECT read_index, best_index::BIGINT AS best_index FROM decoded WHERE low = 'conditional'")
def pamld_noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir).where("sample_0.low = 'conditional'").select("read_index", _int("sample_0.best_index"))


@query(f"{DECODED} SELECT read_index, best_index::BIGINT AS best_index, round(confidence, 6) AS confidence FROM decoded WHERE low = 'confidence'")
def pamld_confidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir).where("sample_0.low = 'confidence'").select("read_index", _int("sample_0.best_index"), F.round("sample_0.confidence", 6).alias("confidence"))


@query(f"{DECODED} SELECT high_quality_distance::BIGINT AS high_quality_distance, count(*) AS n, count(*) FILTER (WHERE fail) AS failed FROM decoded GROUP BY 1")
def high_quality_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir).groupBy(_int("sample_0.high_quality_distance")).agg(F.count("*").alias("n"), F.count_if("sample_0.fail").alias("failed"))


def _pairs() -> list[tuple[str, str]]:
    return [(a, b) for a in syn.WORDS for b in syn.WORDS]


_PAIR_CODEC = "pairs(barcode_index, word, concentration) AS (SELECT (a.barcode_index - 1) * 16 + b.barcode_index, concat(a.word, b.word), (a.concentration * b.concentration / " + repr(1 - syn.NOISE) + ")::DOUBLE FROM codec a, codec b)"


@query(
    f"""{READS}, {_CODEC}, {_PAIR_CODEC}, joined AS (SELECT read_index, concat(substring(s0_seq, 1, 8), s1_seq) AS seq, concat(substring(s0_qual, 1, 8), s1_qual) AS qual FROM reads),
given AS (SELECT read_index, barcode_index, concentration, pow(10.0::DOUBLE, {_sigma(16, "seq", "qual")} / -10.0::DOUBLE) AS conditional FROM joined, pairs),
scored AS (SELECT read_index, barcode_index, conditional, conditional * concentration AS joint FROM given),
ranked AS (SELECT *, row_number() OVER (PARTITION BY read_index ORDER BY joint DESC, barcode_index) AS place, sum(joint) OVER (PARTITION BY read_index) AS total FROM scored)
SELECT read_index, barcode_index::BIGINT AS best_index, CASE WHEN conditional > {0.25**16!r}::DOUBLE THEN round(joint / (total + {syn.NOISE * 0.25**16!r}::DOUBLE), 5) END AS posterior FROM ranked WHERE place = 1"""
)
def pamld_large_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """256 barcodes of two segments, through the Arrow kernel."""
    from dataclasses import replace

    prior = {w: c for w, c in zip(syn.WORDS, syn.CONCENTRATIONS, strict=True)}
    codec = tuple(decode.Barcode(f"@{a}{b}", (a, b), prior[a] * prior[b] / (1 - syn.NOISE)) for a, b in _pairs())
    decoder = replace(syn.sample_decoder(), transform=Transform.parse({"token": ["0::8", "1::8"]}), barcodes=codec, confidence_threshold=0.0, high_quality_distance_threshold=0, random_probability=0.25**16)
    out = decode.decode_all(syn.reads(spark, sf_dir), [decoder], syn.source())
    posterior = F.when(F.col("sample_0.low") == "conditional", F.lit(None)).otherwise(F.col("sample_0.confidence"))
    return out.select("read_index", _int("sample_0.best_index"), F.round(posterior, 5).alias("posterior"))


_EVEN = (1 - syn.NOISE) / 16
_EVEN_CODEC = "even(barcode_index, word) AS (VALUES " + ", ".join(f"({i + 1}, '{w}')" for i, w in enumerate(syn.WORDS)) + ")"


@query(
    f"""{READS}, {_EVEN_CODEC}, scored AS (SELECT read_index, barcode_index, {_sigma()} AS cost FROM reads, even),
ranked AS (SELECT *, row_number() OVER (PARTITION BY read_index ORDER BY round(cost, 7), barcode_index) AS place, sum(pow(10.0::DOUBLE, cost / -10.0::DOUBLE)) OVER (PARTITION BY read_index) AS total FROM scored)
SELECT read_index, barcode_index::BIGINT AS best_index, round(pow(10.0::DOUBLE, cost / -10.0::DOUBLE) * {_EVEN!r}::DOUBLE / (total * {_EVEN!r}::DOUBLE), 6) AS posterior FROM ranked WHERE place = 1"""
)
def pamld_equal_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With equal priors, barcodes often tie: the first one of them is taken."""
    out = _decoded(spark, sf_dir, barcodes=syn.barcodes(tuple(_EVEN for _ in syn.WORDS)), random_probability=0.0, confidence_threshold=0.0, high_quality_distance_threshold=0)
    return out.select("read_index", _int("sample_0.best_index"), F.round("sample_0.confidence", 6).alias("posterior"))


_DUAL = [(a, syn.WORDS[(5 * i + 3) % 16]) for i, a in enumerate(syn.WORDS)]
_DUAL_CODEC = "dual(barcode_index, word1, word0) AS (VALUES " + ", ".join(f"({i + 1}, '{a}', '{b}')" for i, (a, b) in enumerate(_DUAL)) + ")"
_ZERO = {"seq": "s0_seq", "qual": "s0_qual", "word": "word0"}
_DUAL_COST = f"{_sigma(word='word1')} + {_sigma(**_ZERO)}"


def _dual(spark: SparkSession, sf_dir: str, **changes) -> DataFrame:
    """Two segments, of which the first one is short in some reads."""
    codec = tuple(decode.Barcode(f"@{a}{b}", (a, b), _EVEN) for a, b in _DUAL)
    decoder = syn.sample_decoder(transform=Transform.parse({"token": ["1::8", "0::8"]}), barcodes=codec, undetermined=decode.Barcode("undetermined", ("=" * 8, "=" * 8), syn.NOISE), **changes)
    return decode.decode_all(syn.reads(spark, sf_dir), [decoder], syn.source()).withColumns(dict(zip(("corrected", "corrected_quality"), assemble.corrected_barcode(decoder), strict=True)))


_DUAL_BEST = f"""{READS}, {_DUAL_CODEC}, costs AS (SELECT read_index, barcode_index, word1, word0, {_DUAL_COST} AS cost, {_apart(word='word1')} + {_apart(seq='s0_seq', word='word0')} AS distance FROM reads, dual),
ranked AS (SELECT *, row_number() OVER (PARTITION BY read_index ORDER BY round(cost, 7), barcode_index) AS place FROM costs),
best AS (SELECT *, pow(10.0::DOUBLE, cost / -10.0::DOUBLE) > 0.000000001::DOUBLE AS likely FROM ranked WHERE place = 1)"""


@query(f"{_DUAL_BEST} SELECT read_index, barcode_index::BIGINT AS best_index, CASE WHEN likely THEN barcode_index ELSE 0 END::BIGINT AS barcode_index, CASE WHEN likely THEN distance ELSE 0 END::BIGINT AS distance, round(cost, 6) AS cost FROM best")
def pamld_short_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _dual(spark, sf_dir, random_probability=1e-9)
    return out.select("read_index", _int("sample_0.best_index"), _int("sample_0.barcode_index"), _int("sample_0.distance"), F.round(-10 * F.log10("sample_0.conditional"), 6).alias("cost"))


def _corrected_of(n: int, seq: str, qual: str, word: str) -> tuple[str, str]:
    return (
        f"substring(CASE WHEN likely THEN {word} ELSE '{'=' * n}' END, 1, length({seq}))",
        "concat(" + ", ".join(f"CASE WHEN length({seq}) <= {j} THEN '' WHEN NOT likely OR {_o(j, seq)} = substring({word}, {j + 1}, 1) THEN substring({qual}, {j + 1}, 1) ELSE '{chr(30 + 33)}' END" for j in range(n)) + ")",
    )


_FRONT0 = "cut AS (SELECT b.read_index, b.likely, b.word1, b.word0, s1_seq, s1_qual, substring(s0_seq, 1, 8) AS f_seq, substring(s0_qual, 1, 8) AS f_qual FROM best b JOIN reads r ON b.read_index = r.read_index)"
_PARTS = _corrected_of(8, "s1_seq", "s1_qual", "word1"), _corrected_of(8, "f_seq", "f_qual", "word0")


@query(f"{_DUAL_BEST}, {_FRONT0} SELECT read_index, concat({_PARTS[0][0]}, {_PARTS[1][0]}) AS seq, concat({_PARTS[0][1]}, {_PARTS[1][1]}) AS qual FROM cut")
def corrected_short_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dual(spark, sf_dir, random_probability=1e-9).select("read_index", F.col("corrected").alias("seq"), F.col("corrected_quality").alias("qual"))


@query(
    f"""{READS}, {_DUAL_CODEC}, apart AS (SELECT read_index, barcode_index, concat(substring(s1_seq, 1, 8), substring(s0_seq, 1, 8)) = concat(word1, word0) AS exact, {_apart_observed(word='word1')} AS apart1, {_apart_observed(**_ZERO)} AS apart0 FROM reads, dual),
held AS (SELECT *, row_number() OVER (PARTITION BY read_index ORDER BY exact DESC, barcode_index) AS place FROM apart WHERE exact OR (apart1 <= 2 AND apart0 <= 2))
SELECT r.read_index, coalesce(barcode_index, 0)::BIGINT AS barcode_index, CASE WHEN exact THEN 0 ELSE coalesce(apart1 + apart0, 0) END::BIGINT AS distance FROM reads r LEFT JOIN (SELECT * FROM held WHERE place = 1) h ON r.read_index = h.read_index"""
)
def mdd_short_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _dual(spark, sf_dir, algorithm="mdd", distance_tolerance=(2, 2))
    return out.select("read_index", _int("sample_0.barcode_index"), _int("sample_0.distance"))


# ---------------------------------------------------------------- other decoders and their chain


@query(f"{READS} SELECT read_index, substring(s0_seq, 9, 8) AS raw, substring(s0_qual, 9, 8) AS raw_quality, 0 AS barcode_index FROM reads")
def naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode.decode_all(syn.reads(spark, sf_dir), [syn.molecular_decoder()], syn.source())
    return out.select("read_index", "molecular_0.raw", "molecular_0.raw_quality", "molecular_0.barcode_index")


@query(f"{READS} SELECT 0 AS barcode_index, count(*) AS count, count(*) FILTER (WHERE NOT qcfail) AS pf_count FROM reads")
def passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode.decode_all(syn.reads(spark, sf_dir), [decode.Decoder("sample", "passthrough")], syn.source())
    return out.groupBy("sample_0.barcode_index").agg(F.count("*").alias("count"), F.count_if(~F.col("qcfail")).alias("pf_count"))


_CHAIN = f"{DECODED}, {_nearest(seq='s0_seq', qual='s0_qual', name='cell')}, chain AS (SELECT d.*, c.barcode_index AS cell_index, c.distance AS cell_distance, (qcfail OR fail) AS failed1, (qcfail OR fail OR c.barcode_index = 0) AS failed2 FROM decoded d JOIN cell c USING (read_index))"


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.decode_all(syn.reads(spark, sf_dir), syn.decoders(), syn.source())


@query(f"{_CHAIN} SELECT read_index, barcode_index::BIGINT AS sample_index, cell_index::BIGINT AS cell_index, failed1 AS qcfail_sample, failed2 AS qcfail FROM chain")
def multi_decoder_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _chain(spark, sf_dir)
    return out.select("read_index", F.col("sample_0.barcode_index").cast("long").alias("sample_index"), F.col("cellular_0.barcode_index").cast("long").alias("cell_index"), F.col("molecular_0_qcfail").alias("qcfail_sample"), "qcfail")


@query(f"{DECODED} SELECT read_index, concat('FC:1:', coalesce(word, 'undetermined')) AS read_group FROM decoded LEFT JOIN codec ON decoded.barcode_index = codec.barcode_index")
def read_group_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir).select("read_index", assemble.read_group(syn.sample_decoder()).alias("read_group"))


_FIXED = chr(30 + 33)
_CORRECTED = (
    "CASE WHEN barcode_index = 0 THEN substring('========', 1, length(s1_seq)) ELSE substring(word, 1, length(s1_seq)) END",
    "concat(" + ", ".join(f"CASE WHEN length(s1_seq) <= {j} THEN '' WHEN barcode_index = 0 OR {_o(j)} = substring(word, {j + 1}, 1) THEN substring(s1_qual, {j + 1}, 1) ELSE '{_FIXED}' END" for j in range(8)) + ")",
)


@query(f"{DECODED}, worded AS (SELECT decoded.*, word FROM decoded LEFT JOIN codec ON decoded.barcode_index = codec.barcode_index) SELECT read_index, {_CORRECTED[0]} AS seq, {_CORRECTED[1]} AS qual FROM worded")
def corrected_barcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, q = assemble.corrected_barcode(syn.sample_decoder())
    return _decoded(spark, sf_dir).select("read_index", s.alias("seq"), q.alias("qual"))


# ---------------------------------------------------------------- record text

_TEXT = f"""{_CHAIN}, named AS (SELECT chain.*, coalesce(a.word, 'undetermined') AS group_word, coalesce(b.word, '========') AS cell_word FROM chain LEFT JOIN codec a ON chain.barcode_index = a.barcode_index LEFT JOIN codec b ON chain.cell_index = b.barcode_index),
tagged AS (SELECT *, concat('RG:Z:FC:1:', group_word, chr(9), 'BC:Z:', s1_seq, chr(9), 'QT:Z:', s1_qual, CASE WHEN confidence > 0 AND confidence < 1 AND (1 - confidence)::FLOAT > 0 THEN concat(chr(9), 'XB:f:', printf('%g', (1 - confidence)::FLOAT::DOUBLE)) ELSE '' END,
  chr(9), 'OX:Z:', substring(s0_seq, 9, 8), chr(9), 'BZ:Z:', substring(s0_qual, 9, 8), chr(9), 'CB:Z:', cell_word, chr(9), 'CR:Z:', substring(s0_seq, 1, 8), chr(9), 'CY:Z:', substring(s0_qual, 1, 8)) AS tags FROM named)"""
_OUT = {"token": ["0:16:", "2::"]}


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = assemble.assemble(_chain(spark, sf_dir), Transform.parse(_OUT), syn.decoders(), syn.source(), ["read_index", "name"])
    return assemble.records(made)


@query(f"{_TEXT} SELECT read_index, tags FROM tagged")
def sam_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = assemble.assemble(_chain(spark, sf_dir), Transform.parse(_OUT), syn.decoders(), syn.source(), ["read_index"])
    return made.select("read_index", assemble.tag_text(absent=assemble.absent_tags(syn.decoders())).alias("tags"))


@query(
    f"""{_TEXT} SELECT read_index, 1 AS segment, concat(name, chr(9), CASE WHEN failed2 THEN '589' ELSE '77' END, chr(9), '*', chr(9), '0', chr(9), '0', chr(9), '*', chr(9), '*', chr(9), '0', chr(9), '0', chr(9), substring(s0_seq, 17), chr(9), substring(s0_qual, 17), chr(9), tags) AS line FROM tagged
UNION ALL SELECT read_index, 2, concat(name, chr(9), CASE WHEN failed2 THEN '653' ELSE '141' END, chr(9), '*', chr(9), '0', chr(9), '0', chr(9), '*', chr(9), '*', chr(9), '0', chr(9), '0', chr(9), s2_seq, chr(9), s2_qual, chr(9), tags) FROM tagged"""
)
def sam_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = assemble.assemble(_chain(spark, sf_dir), Transform.parse(_OUT), syn.decoders(), syn.source(), ["read_index", "name"])
    return assemble.sam_lines(made, 2, assemble.absent_tags(syn.decoders())).select("read_index", "segment", "line")


@query(
    f"""{_TEXT} SELECT read_index, 1 AS segment, concat('@', name, ' 1:', CASE WHEN failed2 THEN 'Y' ELSE 'N' END, ':0:', s1_seq, chr(10), substring(s0_seq, 17), chr(10), '+', chr(10), substring(s0_qual, 17)) AS record FROM tagged
UNION ALL SELECT read_index, 2, concat('@', name, ' 2:', CASE WHEN failed2 THEN 'Y' ELSE 'N' END, ':0:', s1_seq, chr(10), s2_seq, chr(10), '+', chr(10), s2_qual) FROM tagged"""
)
def fastq_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("read_index", "segment", assemble.fastq_text().alias("record"))


# ---------------------------------------------------------------- counts


@query(f"{DECODED} SELECT barcode_index AS channel, count(*) AS reads, sum(length(s0_seq) + length(s2_seq))::BIGINT AS bases FROM decoded GROUP BY 1")
def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir).groupBy(F.col("sample_0.barcode_index").alias("channel")).agg(F.count("*").alias("reads"), F.sum(F.length("s0_seq") + F.length("s2_seq")).cast("long").alias("bases"))


@query(f"{_CHAIN} SELECT (SELECT count(*) FROM reads) AS incoming, (SELECT count(*) FROM reads WHERE NOT qcfail) AS incoming_pf, count(*) AS outgoing, count(*) FILTER (WHERE NOT failed2) AS outgoing_pf, count(*) FILTER (WHERE NOT failed2) / count(*)::DOUBLE AS outgoing_pf_fraction FROM chain")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming and outgoing counts in one pass over the reads."""
    out = decode.decode_all(syn.reads(spark, sf_dir).withColumn("incoming_qcfail", F.col("qcfail")), syn.decoders(), syn.source())
    counts = out.agg(F.count("*").alias("incoming"), F.count_if(~F.col("incoming_qcfail")).alias("incoming_pf"), F.count("*").alias("outgoing"), F.count_if(~F.col("qcfail")).alias("outgoing_pf"))
    return counts.withColumn("outgoing_pf_fraction", F.col("outgoing_pf") / F.col("outgoing"))


_COUNTED = """classes AS (SELECT 0 AS barcode_index UNION ALL SELECT barcode_index FROM codec),
own AS (SELECT barcode_index, count(*) AS count, count(*) FILTER (WHERE NOT (qcfail OR fail)) AS pf_count, sum(distance) AS distance, sum(CASE WHEN low = '' AND barcode_index > 0 THEN confidence ELSE 0.0 END) AS confidence FROM decoded GROUP BY 1),
low AS (SELECT best_index AS barcode_index, count(*) FILTER (WHERE low = 'conditional') AS low_conditional, count(*) FILTER (WHERE low = 'confidence') AS low_confidence FROM decoded GROUP BY 1),
counted AS (SELECT barcode_index, coalesce(count, 0) AS count, coalesce(pf_count, 0) AS pf_count, coalesce(distance, 0) AS distance, coalesce(confidence, 0.0) AS confidence, coalesce(low_conditional, 0) AS low_conditional, coalesce(low_confidence, 0) AS low_confidence FROM classes LEFT JOIN own USING (barcode_index) LEFT JOIN low USING (barcode_index)),
total AS (SELECT sum(count)::DOUBLE AS n, sum(pf_count)::DOUBLE AS pf, sum(count) FILTER (WHERE barcode_index > 0)::DOUBLE AS classified, sum(pf_count) FILTER (WHERE barcode_index > 0)::DOUBLE AS pf_classified, sum(low_conditional)::DOUBLE AS conditional, sum(low_confidence)::DOUBLE AS unsure FROM counted),
noise AS (SELECT (conditional + unsure * conditional / (conditional + pf_classified)) / n AS noise FROM total)"""


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoder = syn.sample_decoder()
    counts = stats.barcode_counts(decode.decode_all(syn.reads(spark, sf_dir), [decoder], syn.source()), [decoder])
    codec = spark.createDataFrame([(i,) for i in range(1 + len(decoder.barcodes))], "barcode_index int")
    return stats.barcode_table(counts, codec)


@query(
    f"""{DECODED}, {_COUNTED} SELECT barcode_index, count, pf_count, low_conditional, low_confidence, round(CASE WHEN count > 0 THEN distance::DOUBLE / count ELSE 0.0 END, 9) AS average_distance, round(CASE WHEN count > 0 THEN confidence / count ELSE 0.0 END, 6) AS average_confidence,
round(CASE WHEN count > 0 THEN pf_count::DOUBLE / count ELSE 0.0 END, 9) AS pf_fraction, round(count / n, 9) AS pooled_fraction, round(pf_count / pf, 9) AS pf_pooled_fraction, round(count / classified, 9) AS pooled_classified_fraction FROM counted, total"""
)
def barcode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir)
    exact = ("average_distance", "pf_fraction", "pooled_fraction", "pf_pooled_fraction", "pooled_classified_fraction")
    return t.select("barcode_index", "count", "pf_count", "low_conditional", "low_confidence", F.round("average_confidence", 6).alias("average_confidence"), *[F.round(c, 9).alias(c) for c in exact])


@query(
    f"""{DECODED}, {_COUNTED} SELECT n::BIGINT AS count, pf::BIGINT AS pf_count, classified::BIGINT AS classified_count, pf_classified::BIGINT AS pf_classified_count, round(classified / n, 9) AS classified_fraction, round(pf_classified / pf, 9) AS pf_classified_fraction,
round((SELECT sum(distance) FROM counted WHERE barcode_index > 0)::DOUBLE / classified, 9) AS average_classified_distance, round((SELECT sum(confidence) FROM counted WHERE barcode_index > 0) / classified, 6) AS average_classified_confidence FROM total"""
)
def decoder_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoder = syn.sample_decoder()
    counts = stats.barcode_counts(decode.decode_all(syn.reads(spark, sf_dir), [decoder], syn.source()), [decoder])
    of_class = lambda c: F.sum(F.when(F.col("barcode_index") > 0, F.col(c)).otherwise(0))
    t = counts.agg(F.sum("count").alias("count"), F.sum("pf_count").alias("pf_count"), of_class("count").alias("classified_count"), of_class("pf_count").alias("pf_classified_count"), of_class("distance").alias("_d"), of_class("confidence").alias("_c"))
    return t.select(
        "count", "pf_count", "classified_count", "pf_classified_count",
        F.round(F.col("classified_count") / F.col("count"), 9).alias("classified_fraction"), F.round(F.col("pf_classified_count") / F.col("pf_count"), 9).alias("pf_classified_fraction"),
        F.round(F.col("_d") / F.col("classified_count"), 9).alias("average_classified_distance"), F.round(F.col("_c") / F.col("classified_count"), 6).alias("average_classified_confidence"),
    )


_PRIOR = f"{DECODED}, {_COUNTED}, estimated AS (SELECT barcode_index, (1 - noise) * pf_count / pf_classified AS concentration FROM counted, total, noise WHERE barcode_index > 0)"


@query(f"{_PRIOR} SELECT barcode_index, round(noise, 9) AS estimated_noise, round(concentration, 9) AS estimated_concentration FROM estimated, noise")
def prior_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir).where("barcode_index > 0").select("barcode_index", F.round("estimated_noise", 9).alias("estimated_noise"), F.round("estimated_concentration", 9).alias("estimated_concentration"))


@query(
    f"{_PRIOR}, second AS (SELECT codec.barcode_index, word, estimated.concentration FROM codec JOIN estimated ON codec.barcode_index = estimated.barcode_index), {_likelihood(noise='(SELECT noise FROM noise)', name='again', codec='second')} SELECT barcode_index, count(*) AS count, count(*) FILTER (WHERE NOT (qcfail OR fail)) AS pf_count FROM again GROUP BY 1"
)
def prior_adjusted_second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second pass with the priors that the first one estimated; between them the driver holds a row per class."""
    from dataclasses import replace

    first = syn.sample_decoder()
    reads = syn.reads(spark, sf_dir)
    (report,) = stats.decoder_reports(stats.barcode_counts(decode.decode_all(reads, [first], syn.source()), [first]), [first])
    adjusted = tuple(replace(b, concentration=report.estimated_concentration(i + 1)) for i, b in enumerate(first.barcodes))
    second = decode.decode_all(reads, [replace(first, noise=report.estimated_noise, barcodes=adjusted)], syn.source())
    return second.groupBy("sample_0.barcode_index").agg(F.count("*").alias("count"), F.count_if(~F.col("qcfail")).alias("pf_count"))


# ---------------------------------------------------------------- quality profiles

_BASES = f"{DECODED}, places AS (SELECT unnest(generate_series(0, 50)) AS cycle), bases AS (SELECT barcode_index AS channel, cycle, substring(s2_seq, (cycle + 1)::INT, 1) AS base, least(greatest(ascii(substring(s2_qual, (cycle + 1)::INT, 1)) - 33, 0), 41) AS quality FROM decoded, places WHERE cycle < length(s2_seq))"


def _bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _decoded(spark, sf_dir).withColumn("channel", F.col("sample_0.barcode_index"))
    return stats.base_counts(reads, F.col("s2_seq"), F.col("s2_qual"), ["channel"])


@query(f"{_BASES} SELECT channel, cycle::INT AS cycle, base, quality, count(*) AS n FROM bases GROUP BY ALL")
def cycle_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bases(spark, sf_dir).groupBy("channel", "cycle", "base", "quality").agg(F.sum("n").alias("n"))


@query(f"{_BASES} SELECT channel, cycle::INT AS cycle, coalesce(base, '*') AS base, quality, count(*) AS n FROM bases GROUP BY GROUPING SETS ((channel, cycle, base, quality), (channel, cycle, quality))")
def cycle_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cycle_histogram(_bases(spark, sf_dir), ["channel"])


def _quantile_sql(p: float) -> str:
    return f"CASE WHEN floor(max(total) * {p}) < 1 THEN 0 ELSE min(quality) FILTER (WHERE up_to >= floor(total * {p})) END"


_STATS = f"""{_BASES}, histogram AS (SELECT cycle::INT AS cycle, quality, count(*) AS n FROM bases GROUP BY ALL),
walked AS (SELECT *, sum(n) OVER (PARTITION BY cycle ORDER BY quality) AS up_to, sum(n) OVER (PARTITION BY cycle) AS total FROM histogram),
stats AS (SELECT cycle, sum(n)::BIGINT AS count, sum(n * quality)::BIGINT AS sum_quality, max(quality) AS max_quality, coalesce(min(quality) FILTER (WHERE quality > 0), 0) AS min_quality, {_quantile_sql(0.25)} AS q1, {_quantile_sql(0.5)} AS median_quality, {_quantile_sql(0.75)} AS q3 FROM walked GROUP BY cycle)"""


@query(
    f"{_STATS} SELECT cycle, count, sum_quality, max_quality, min_quality, q1, median_quality, q3, round(sum_quality::DOUBLE / count, 9) AS mean_quality, q3 - q1 AS iqr, greatest(q1 - (q3 - q1) * 1.5, min_quality)::DOUBLE AS left_whisker, least(q3 + (q3 - q1) * 1.5, max_quality)::DOUBLE AS right_whisker FROM stats"
)
def cycle_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = _bases(spark, sf_dir).groupBy("cycle", "quality").agg(F.sum("n").alias("n"))
    out = stats.histogram_stats(histogram, ["cycle"])
    doubles = ("left_whisker", "right_whisker")
    return out.select("cycle", "count", "sum_quality", "max_quality", "min_quality", "q1", "median_quality", "q3", F.round("mean_quality", 9).alias("mean_quality"), "iqr", *[F.col(c).cast("double").alias(c) for c in doubles])


_AVERAGE = _sum(f"CASE WHEN length(s2_qual) > {j} THEN {_q(j, 's2_qual')} ELSE 0 END" for j in range(51))


@query(f"{READS}, average AS (SELECT {_AVERAGE}::DOUBLE / length(s2_qual) AS mean FROM reads WHERE length(s2_qual) > 0) SELECT least(floor(mean), 41)::INT AS bin, count(*) AS n, round(max(mean), 9) AS max_mean FROM average GROUP BY 1")
def average_phred_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = stats.average_quality(F.col("s2_qual"))
    reads = syn.reads(spark, sf_dir).select(mean.alias("mean")).where("mean is not null")
    return reads.groupBy(F.least(F.floor("mean"), F.lit(41)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.max("mean"), 9).alias("max_mean"))


@query(f"{READS} " + " UNION ALL ".join(f"SELECT {i} AS segment, min(length(s{i}_seq))::INT AS shortest, max(length(s{i}_seq))::INT AS longest, sum(length(s{i}_seq))::BIGINT AS bases, sum(length(s{i}_seq) - length(replace(s{i}_seq, 'N', '')))::BIGINT AS unknown FROM reads" for i in range(3)))
def length_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = F.array(*[F.struct(F.lit(i).alias("segment"), F.length(f"s{i}_seq").alias("n"), (F.length(f"s{i}_seq") - F.length(F.replace(F.col(f"s{i}_seq"), F.lit("N"), F.lit("")))).alias("unknown")) for i in range(3)])
    flat = syn.reads(spark, sf_dir).select(F.explode(lengths).alias("s")).select("s.*")
    return flat.groupBy("segment").agg(F.min("n").alias("shortest"), F.max("n").alias("longest"), F.sum("n").cast("long").alias("bases"), F.sum("unknown").cast("long").alias("unknown"))


# ---------------------------------------------------------------- codecs

_MATRIX = f"WITH {_CODEC}, pair AS (SELECT a.barcode_index AS i, b.barcode_index AS j, hamming(a.word, b.word)::INT AS distance FROM codec a JOIN codec b ON a.barcode_index < b.barcode_index)"


def _codec(spark: SparkSession) -> DataFrame:
    return metrics.codec_frame(spark, [(w,) for w in syn.WORDS])


@query(f"{_MATRIX} SELECT min(distance) AS distance, ((min(distance) - 1) // 2)::INT AS bound FROM pair")
def codec_min_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distance_matrix(_codec(spark), 8).agg(F.min("distance").alias("distance"), F.min("bound").alias("bound"))


@query(f"{_MATRIX} SELECT 0 AS segment, i, j, distance, ((distance - 1) // 2)::INT AS bound FROM pair")
def codec_distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distance_matrix(_codec(spark), 8)


@query(f"{READS} SELECT s1_seq AS word, count(*) AS n FROM reads GROUP BY 1 HAVING count(*) > 1")
def codec_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a list of barcodes holds more than once."""
    return syn.reads(spark, sf_dir).groupBy(F.col("s1_seq").alias("word")).agg(F.count("*").alias("n")).where("n > 1")
