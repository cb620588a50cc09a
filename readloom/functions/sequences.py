"""Sequences and Phred qualities as string columns.

A sequence is IUPAC text, a quality string of the same length holds one character a base, its code point being
quality plus an offset. All functions build JVM expressions without lambdas, so they stay in whole-stage code.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of the IUPAC code; anything else reads as N. The digits 0 to 3 stand for A, C, G, T.
IUPAC = "ACGTRYSWKMBDHVN="
#: Complements of the letters, fixed values.
COMPLEMENT = ("ACMGRSVTWYHKDBN", "TGKCYSBAWRDMHVN")
UNAMBIGUOUS = "ACGT"
#: Code point of quality 0, and the number of qualities that profiles tell apart.
PHRED_OFFSET, PHRED_BINS = 33, 42
#: Bounds of a valid offset.
PHRED_OFFSETS = (2, 104)
#: Cost in Phred of a base pair that says nothing: one of four.
UNIFORM_COST = 10 * math.log10(4)


def error_probability(quality: float) -> float:
    return 10 ** (-quality / 10)


def match_cost(quality: int) -> float:
    """Phred cost of an observed base that equals the expected one. Quality 0 says nothing and costs nothing."""
    return -10 * math.log10(1 - error_probability(quality)) if quality > 0 else 0.0


#: Match costs of the qualities 0 to 93.
MATCH_COSTS = tuple(match_cost(q) for q in range(94))


def normalise(sequence: Column) -> Column:
    """Upper case, digits to bases, unknown letters to N."""
    return F.regexp_replace(F.translate(F.upper(sequence), "0123", UNAMBIGUOUS), f"[^{IUPAC}]", "N")


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, *COMPLEMENT))


def base(sequence: Column, place: int) -> Column:
    """The base at a place (from 0); the empty string beyond the end."""
    return F.substring(sequence, place + 1, 1)


def quality(qualities: Column, place: int, offset: int = PHRED_OFFSET) -> Column:
    return F.ascii(F.substring(qualities, place + 1, 1)) - offset


def total(terms: list[Column]) -> Column:
    """Sum from left to right."""
    return reduce(lambda a, b: a + b, terms)


def hamming(sequence: Column, word: str) -> Column:
    """Places of a constant word in which the sequence differs; places beyond its end differ."""
    return total([F.when(base(sequence, i) == c, 0).otherwise(1) for i, c in enumerate(word)])


def hamming_of_observed(sequence: Column, word: str, qualities: Column | None = None, least: int = 0, offset: int = PHRED_OFFSET) -> Column:
    """As hamming(), but places beyond the sequence's end agree. Bases of a quality below `least` differ."""

    def differs(i: int, c: str) -> Column:
        miss = base(sequence, i) != c
        if qualities is not None and least > 0:
            miss = miss | (quality(qualities, i, offset) < least)
        return F.when((F.length(sequence) > i) & miss, 1).otherwise(0)

    return total([differs(i, c) for i, c in enumerate(word)])


def is_strict(sequence: Column) -> Column:
    """Every base is A, C, G or T."""
    return sequence.rlike(f"^[{UNAMBIGUOUS}]*$")


def expected_error(qualities: Column, width: int, offset: int = PHRED_OFFSET) -> Column:
    """Sum of error probabilities of the first `width` bases, from left to right."""
    return total([F.when(F.length(qualities) > i, F.pow(F.lit(10.0), -quality(qualities, i, offset) / F.lit(10.0))).otherwise(0.0) for i in range(width)])


def slice_column(value: Column, start: int | None, end: int | None) -> Column:
    """value[start:end] by the rules of tokens: bounds below 0 count from the end and stop at 0, a start behind the end of the value is 0, an end behind it or missing is the end."""
    length = F.length(value)
    low = F.lit(0) if start is None else F.greatest(length + start, F.lit(0)) if start < 0 else F.when(F.lit(start) > length, 0).otherwise(start)
    high = length if end is None else F.greatest(length + end, F.lit(0)) if end < 0 else F.least(F.lit(end), length)
    return F.substring(value, low + 1, F.greatest(high - low, F.lit(0)))
