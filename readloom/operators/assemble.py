"""Output segments: template slices, corrected barcodes, flags, SAM-style annotations, and record text."""

from __future__ import annotations

from collections.abc import Container

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import sequences, tokens
from readloom.functions.tokens import Transform
from readloom.operators import decode
from readloom.operators.decode import Decoder

# Bits of a record's flag, fixed by the format.
PAIRED, UNMAPPED, MATE_UNMAPPED, READ1, READ2, QCFAIL = 0x1, 0x4, 0x8, 0x40, 0x80, 0x200
#: Order and type of annotations, fixed by the format. TC is written with FI only for more than two segments.
TAGS = ("FI:i", "TC:i", "FS:Z", "RG:Z", "PU:Z", "LB:Z", "PG:Z", "CO:Z", "BC:Z", "QT:Z", "XB:f", "RX:Z", "QX:Z", "OX:Z", "BZ:Z", "MI:Z", "XM:f", "CB:Z", "CR:Z", "CY:Z", "XC:f", "XO:f", "EE:f")
#: Annotations of raw bases, raw quality, corrected bases, corrected quality and error probability of each topic.
TOPIC_TAGS = {"sample": ("BC", "QT", None, None, "XB"), "cellular": ("CR", "CY", "CB", None, "XC"), "molecular": ("OX", "BZ", "RX", "QX", "XM")}
_LETTER = {v: k for k, v in tokens.BARCODE_SOURCES.items()}


def corrected_barcode(decoder: Decoder, offset: int = sequences.PHRED_OFFSET) -> tuple[Column, Column]:
    """Bases of the decoded class, and the observed quality where the base stands or none is decoded, else the decoder's corrected quality. An unclassified read has '=' for every observed base."""
    column = F.col(decoder.column)
    raw, quality, index = column["raw"], column["raw_quality"], column["barcode_index"]
    fixed = F.lit(chr(decoder.corrected_quality + offset))
    bases, kept = [], []
    widths = decoder.transform.widths()
    before = F.lit(0)
    for k, width in enumerate(widths):
        word = F.element_at(decode.listed(["=" * width, *[b.segments[k] for b in decoder.barcodes]]), index + 1)
        length = F.length(raw) if len(widths) == 1 else column["lengths"][k]
        bases.append(F.substring(word, F.lit(1), length))
        for j in range(width):
            place = before + (j + 1)
            same = (index == 0) | (F.substring(word, j + 1, 1) == F.substring(raw, place, F.lit(1)))
            kept.append(F.when(length <= j, "").when(same, F.substring(quality, place, F.lit(1))).otherwise(fixed))
        before = before + length
    return _joined(bases), F.concat(*kept)


def _joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def read_group(decoder: Decoder) -> Column:
    """The id of the read group of the decoded class."""
    ids = [decoder.undetermined.attributes.get("ID", "undetermined"), *[b.attributes.get("ID", b.key) for b in decoder.barcodes]]
    return F.element_at(decode.listed(ids), F.col(f"{decoder.column}.barcode_index") + 1)


def topic_columns(decoders: list[Decoder], offset: int = sequences.PHRED_OFFSET) -> dict[str, Column]:
    """Annotation columns by tag, over all decoders of each topic: raw and corrected bases join, confidences multiply."""
    out: dict[str, Column] = {}
    for topic, (raw, quality, corrected, corrected_quality, error) in TOPIC_TAGS.items():
        mine = [d for d in decoders if d.topic == topic and d.algorithm != "passthrough"]
        if not mine:
            continue
        out[raw] = _joined([F.col(f"{d.column}.raw") for d in mine])
        out[quality] = _joined([F.col(f"{d.column}.raw_quality") for d in mine])
        closed = [d for d in mine if d.algorithm != "naive"]
        if corrected and closed:
            pairs = [corrected_barcode(d, offset) for d in closed]
            out[corrected] = _joined([p[0] for p in pairs])
            if corrected_quality:
                out[corrected_quality] = _joined([p[1] for p in pairs])
        scored = [d for d in mine if d.algorithm == "pamld"]
        if scored:
            confidence = F.lit(1.0)
            for d in scored:
                confidence = confidence * F.col(f"{d.column}.confidence")
            # kept in 32 bits
            out[error] = F.when((confidence > 0) & (confidence < 1), (1 - confidence).cast("float"))
    sample = [d for d in decoders if d.topic == "sample"]
    if sample:
        out["RG"] = read_group(sample[0])
    return out


def template_source(decoders: list[Decoder], source: dict[str, tuple[Column, Column]], offset: int = sequences.PHRED_OFFSET) -> dict[str, tuple[Column, Column]]:
    """What template tokens may read: input segments by number, corrected barcodes by letter."""
    out = dict(source)
    for topic, letter in _LETTER.items():
        pairs = [corrected_barcode(d, offset) for d in decoders if d.topic == topic and d.algorithm in ("pamld", "mdd")]
        if pairs:
            out[letter] = _joined([p[0] for p in pairs]), _joined([p[1] for p in pairs])
    return out


def flags(n: int, qcfail: Column) -> list[Column]:
    """The flag of each of n output segments."""
    out = []
    for i in range(n):
        bits = UNMAPPED | MATE_UNMAPPED | (PAIRED if n > 1 else 0) | (READ1 if i == 0 else READ2 if i == n - 1 else 0)
        out.append(F.when(qcfail, bits | QCFAIL).otherwise(bits))
    return out


def assemble(df: DataFrame, template: Transform, decoders: list[Decoder], source: dict[str, tuple[Column, Column]], keep: list[str], offset: int = sequences.PHRED_OFFSET) -> DataFrame:
    """The columns in keep, tags (a struct by tag) and segments (an array of segment, flag, seq, qual)."""
    cut = tokens.apply(template, template_source(decoders, source, offset))
    bits = flags(len(cut), F.col("qcfail"))
    segments = F.array(*[F.struct(F.lit(i + 1).alias("segment"), b.alias("flag"), s.alias("seq"), q.alias("qual")) for i, ((s, q), b) in enumerate(zip(cut, bits, strict=True))])
    annotations = topic_columns(decoders, offset)
    tags = F.struct(*[annotations.get(t[:2], F.lit(None).cast({"i": "int", "Z": "string", "f": "float"}[t[3]])).alias(t[:2]) for t in TAGS])
    return df.select(*keep, tags.alias("tags"), segments.alias("segments"))


def short_float(value: Column) -> Column:
    """A number as text with six significant digits, like the C format %g; null and what is not positive as the empty string."""

    def kernel(column: pa.Array) -> pa.Array:
        numbers = column.to_numpy(zero_copy_only=False)
        out = np.full(len(numbers), "", object)
        some = np.flatnonzero(numbers > 0)
        out[some] = ["%g" % x for x in numbers[some].tolist()]
        return pa.array(out, pa.string())

    return F.arrow_udf(kernel, "string")(value.cast("double"))


def tag_text(tags: str = "tags", segment: Column | None = None, total: Column | None = None, absent: Container[str] = ()) -> Column:
    """Annotations in order, joined by tabs; empty ones, and numbers that are not positive, are left out. absent: annotations that no read has, as the plan knows."""
    parts = []
    for tag in TAGS:
        name, kind = tag.split(":")
        value = F.col(f"{tags}.{name}")
        if name in ("FI", "TC") and segment is not None:
            value = F.when(total > 2, segment if name == "FI" else total)
        if name in absent:
            continue
        shown = short_float(value) if kind == "f" else value.cast("string")
        there = (value > 0) if kind == "i" else (shown != "")
        parts.append(F.when(there, F.concat(F.lit(f"{tag}:"), shown)))
    return F.concat_ws("\t", *parts)


def sam_text(records: DataFrame, absent: Container[str] = ()) -> Column:
    """A SAM line of name, segment, total, flag, seq, qual and tags columns."""
    annotations = tag_text("tags", F.col("segment"), F.col("total"), absent)
    fixed = F.concat_ws("\t", F.col("name"), F.col("flag").cast("string"), F.lit("*\t0\t0\t*\t*\t0\t0"), F.when(F.col("seq") == "", "*").otherwise(F.col("seq")), F.when(F.col("qual") == "", "*").otherwise(F.col("qual")))
    return F.when(annotations == "", fixed).otherwise(F.concat(fixed, F.lit("\t"), annotations))


def absent_tags(decoders: list[Decoder], others: Container[str] = ()) -> set[str]:
    """Annotations that neither the decoders make nor the input has (others)."""
    made = topic_columns(decoders)
    return {t[:2] for t in TAGS if t[:2] not in made and t[:2] not in others and t[:2] not in ("FI", "TC")}


def sam_lines(assembled: DataFrame, n: int, absent: Container[str] = ()) -> DataFrame:
    """SAM lines of assembled reads of n output segments: the other columns, segment and line. Annotations that all segments share are written once a read."""
    others = [c for c in assembled.columns if c not in ("segments", "tags")]
    shared = [assembled[c] for c in others]
    absent = {*absent, *(() if n > 2 else ("FI", "TC"))}
    texts = [tag_text("tags", F.lit(i + 1), F.lit(n), absent) for i in range(n if n > 2 else 1)]
    read = assembled.select(*shared, F.col("name").alias("_name"), F.array(*texts).alias("_tags"), "segments").select(*others, "_name", "_tags", F.explode("segments").alias("_s"))
    annotations = F.element_at("_tags", F.col("_s.segment") if n > 2 else F.lit(1))
    star = lambda c: F.when(F.col(f"_s.{c}") == "", "*").otherwise(F.col(f"_s.{c}"))
    fixed = F.concat(F.col("_name"), F.lit("\t"), F.col("_s.flag").cast("string"), F.lit("\t*\t0\t0\t*\t*\t0\t0\t"), star("seq"), F.lit("\t"), star("qual"))
    return read.select(*others, "_s.segment", F.when(annotations == "", fixed).otherwise(F.concat(fixed, F.lit("\t"), annotations)).alias("line"))


def fastq_text(platform: str = "ILLUMINA", from_offset: int = sequences.PHRED_OFFSET, to_offset: int = sequences.PHRED_OFFSET) -> Column:
    """A FASTQ record of name, segment, flag, seq, qual and tags columns, without its last line end. The comment of platforms that have one is segment:Y or N:0:barcode."""
    failed = F.when(F.col("flag").bitwiseAND(QCFAIL) > 0, "Y").otherwise("N")
    comment = F.concat_ws(":", F.col("segment").cast("string"), failed, F.lit("0"), F.coalesce("tags.BC", F.lit(""))) if platform in ("ILLUMINA", "ELEMENT") else F.lit("")
    quality = F.col("qual")
    if from_offset != to_offset:
        shown = "".join(map(chr, range(from_offset, 127)))
        quality = F.translate(quality, shown, "".join(chr(min(126, ord(c) - from_offset + to_offset)) for c in shown))
    return F.concat(F.lit("@"), F.col("name"), F.lit(" "), comment, F.lit("\n"), F.col("seq"), F.lit("\n+\n"), quality)


def records(assembled: DataFrame) -> DataFrame:
    """A row per output segment: the read's columns, segment (from 1), total, flag, seq and qual."""
    others = [c for c in assembled.columns if c != "segments"]
    return assembled.select(*others, F.size("segments").alias("total"), F.explode("segments").alias("s")).select(*others, "total", "s.*")
