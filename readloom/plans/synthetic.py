"""Synthetic reads over the tables of events: three segments derived from hashes, the same in every SQL engine.

Segment 0 (51 bases) begins with a cell barcode, segment 1 (8, a few truncated) is a sample barcode with some
substitutions, segment 2 has 18 to 51 bases. The expressions use only functions that SQL engines share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.tokens import Transform
from readloom.operators.decode import Barcode, Decoder

HEX = "0123456789abcdef"
#: Quality characters of the hexadecimal digits (7 to 41).
QUALITIES = "(+/258<?BDEFGHIJ"
#: Sixteen words of eight bases, five or more apart.
WORDS = (
    "GCCTGATT", "CGTATGCA", "CGCGATAG", "TCGATATG", "GCTGTTCG", "ATTGCGCT", "CACAGTTC", "AGATGACG",
    "TATCTGAG", "ACCATGAC", "TTGCATAC", "GTTAAAGG", "ACTTACAG", "CTACTCTG", "TGATACTA", "TCTAGCGA",
)
NOISE, THRESHOLD, HIGH, HIGH_DISTANCE, MASK = 0.02, 0.95, 30, 2, 12
#: Priors of the sample barcodes: all different, so that likelihoods never tie.
CONCENTRATIONS = tuple((1 - NOISE) * (20 + i) / sum(range(20, 36)) for i in range(16))
LEAST_LENGTH = 24


def _digit(source: str, place: int) -> str:
    return f"(instr('{HEX}', substring({source}, {place}, 1)) - 1)"


def _set(text: str, place: str, letter: str) -> str:
    """text with the letter at a place from 0."""
    return f"concat(substring({text}, 1, {place}), {letter}, substring({text}, {place} + 2))"


def _bases(text: str) -> str:
    return f"translate({text}, '{HEX}', 'ACGTACGTACGTACGT')"


#: Steps of the derivation: new columns by name, each over those before.
_STEPS: tuple[dict[str, str], ...] = (
    {h: f"md5(concat('{h}', cast(event_id as string)))" for h in ("ha", "hb", "hc", "hm", "hq", "hr", "hs", "ht")}
    | {"read_index": "event_id", "name": "concat('SYN:1:FC:1:1101:', cast(event_id as string))"}
    | {"word1": f"substring('{''.join(WORDS)}', cast(user_id % 16 as int) * 8 + 1, 8)", "word0": f"substring('{''.join(WORDS)}', cast(event_id % 16 as int) * 8 + 1, 8)"},
    {
        "qcfail": "substring(hm, 12, 1) = '0'",
        "kind": "substring(hm, 1, 1)",
        "place1": f"cast({_digit('hm', 2)} % 8 as int)", "letter1": f"substring('ACGT', cast({_digit('hm', 3)} % 4 as int) + 1, 1)",
        "place2": f"cast({_digit('hm', 4)} % 8 as int)", "letter2": f"substring('ACGT', cast({_digit('hm', 5)} % 4 as int) + 1, 1)",
        "long2": f"cast(18 + ({_digit('hm', 6)} * 16 + {_digit('hm', 7)}) % 34 as int)",
    },
    {"once": f"case when kind in ('b', 'c', 'd', 'e') then {_set('word1', 'place1', 'letter1')} when kind = 'f' then {_set('word1', 'place1', repr('N'))} else word1 end"},
    {"twice": f"case when kind in ('d', 'e') then {_set('once', 'place2', 'letter2')} else once end"},
    {
        "s1_seq": "case when substring(hm, 8, 2) = '00' then substring(twice, 1, 6) else twice end",
        "s0_seq": f"concat(case when substring(hm, 10, 1) in ('e', 'f') then {_set('word0', 'place2', 'letter1')} else word0 end, substring({_bases('concat(ha, hb)')}, 1, 43))",
        "s0_qual": f"translate(substring(concat(hq, hr), 1, 51), '{HEX}', '{QUALITIES}')",
        "s2_seq": f"substring({_bases('concat(hb, hc)')}, 1, long2)",
        "s2_qual": f"substring(translate(concat(hr, hs), '{HEX}', '{QUALITIES}'), 1, long2)",
    },
    {"s1_qual": f"translate(substring(ht, 1, length(s1_seq)), '{HEX}', '{QUALITIES}')"},
)
COLUMNS = ("read_index", "name", "qcfail", "s0_seq", "s0_qual", "s1_seq", "s1_qual", "s2_seq", "s2_qual")


def reads_of(events: DataFrame) -> DataFrame:
    """Synthetic reads of a frame with event_id and user_id."""
    df = events.select("event_id", "user_id")
    for step in _STEPS:
        df = df.withColumns({k: F.expr(v) for k, v in step.items()})
    return df.select(*COLUMNS)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def sql_reads(table: str = "events") -> str:
    """The same reads as common table expressions, ending in `reads`."""
    parts, before = [], table
    for i, step in enumerate(_STEPS):
        columns = ", ".join(f"{v} AS {k}" for k, v in step.items())
        parts.append(f"step{i} AS (SELECT *, {columns} FROM {before})")
        before = f"step{i}"
    return "WITH " + ", ".join(parts) + f", reads AS (SELECT {', '.join(COLUMNS)} FROM {before})"


def source(n: int = 3) -> dict[str, tuple[Column, Column]]:
    return {str(i): (F.col(f"s{i}_seq"), F.col(f"s{i}_qual")) for i in range(n)}


def barcodes(concentrations: tuple[float, ...] = CONCENTRATIONS) -> tuple[Barcode, ...]:
    return tuple(Barcode(f"@{w}", (w,), c, {"ID": f"FC:1:{w}", "BC": w}) for w, c in zip(WORDS, concentrations, strict=True))


UNDETERMINED = Barcode("undetermined", ("=" * 8,), NOISE, {"ID": "FC:1:undetermined"})


def sample_decoder(algorithm: str = "pamld", **changes) -> Decoder:
    given = dict(
        topic="sample", algorithm=algorithm, transform=Transform.parse({"token": ["1::8"]}), barcodes=barcodes(), undetermined=UNDETERMINED, noise=NOISE, confidence_threshold=THRESHOLD,
        high_quality_threshold=HIGH, high_quality_distance_threshold=HIGH_DISTANCE, multiplexing=True,
    )
    return Decoder(**(given | changes))


def cellular_decoder(**changes) -> Decoder:
    even = tuple((1 - NOISE) / 16 for _ in WORDS)
    given = dict(topic="cellular", algorithm="mdd", transform=Transform.parse({"token": ["0::8"]}), barcodes=barcodes(even), undetermined=UNDETERMINED, noise=NOISE)
    return Decoder(**(given | changes))


def molecular_decoder() -> Decoder:
    return Decoder("molecular", "naive", Transform.parse({"token": ["0:8:16"]}))


def decoders() -> list[Decoder]:
    return [sample_decoder(), molecular_decoder(), cellular_decoder()]
