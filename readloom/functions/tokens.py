"""Tokens and knits: which slices of which segments make up an observation or an output segment.

A token is `segment:start:end` with optional bounds; a segment is a number or one of s, c, m for the corrected
sample, cellular and molecular barcode. A knit entry joins token numbers with `:`; `~` before one reverse
complements it. Without a knit every token is a segment of its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions import sequences

_TOKEN = re.compile(r"^(s|c|m|[0-9]+):(-?[0-9]+)?:(-?[0-9]+)?$")
_PART = re.compile(r"^(~?)([0-9]+)$")
#: Sources of template tokens that are not input segments.
BARCODE_SOURCES = {"s": "sample", "c": "cellular", "m": "molecular"}


class PlanError(ValueError):
    """A job that cannot be compiled."""


@dataclass(frozen=True)
class Token:
    segment: str
    start: int | None = None
    end: int | None = None

    @classmethod
    def parse(cls, text: str) -> Token:
        m = _TOKEN.match(text)
        if not m:
            raise PlanError(f"illegal token {text!r}")
        return cls(m[1] if m[1] in BARCODE_SOURCES else str(int(m[1])), None if m[2] is None else int(m[2]), None if m[3] is None else int(m[3]))

    @property
    def width(self) -> int | None:
        """The number of bases if no input can change it, else None."""
        start, end = self.start or 0, self.end
        if end is None:
            return -start if start < 0 else None
        if (start < 0) == (end < 0):
            return max(0, end - start)
        return None

    def __str__(self) -> str:
        return f"{self.segment}:{'' if self.start is None else self.start}:{'' if self.end is None else self.end}"

    def describe(self) -> str:
        where = f"the corrected {BARCODE_SOURCES[self.segment]} barcode" if self.segment in BARCODE_SOURCES else f"input segment {self.segment}"
        bound = lambda x: f"{-x} from the end" if x < 0 else str(x)
        return f"bases of {where} from {bound(self.start or 0)} to {'the end' if self.end is None else bound(self.end)}"


@dataclass(frozen=True)
class Transform:
    tokens: tuple[Token, ...]
    #: For each produced segment, the (token number, reverse complemented) it is made of.
    knit: tuple[tuple[tuple[int, bool], ...], ...]

    @classmethod
    def parse(cls, document: dict | None) -> Transform:
        document = document or {}
        tokens = tuple(Token.parse(t) for t in document.get("token", ()))
        entries = document.get("knit") or [str(i) for i in range(len(tokens))]
        knit = []
        for entry in entries:
            parts = []
            for part in entry.split(":"):
                m = _PART.match(part)
                if not m or int(m[2]) >= len(tokens):
                    raise PlanError(f"illegal knit {entry!r}")
                parts.append((int(m[2]), bool(m[1])))
            knit.append(tuple(parts))
        return cls(tokens, tuple(knit))

    def widths(self) -> tuple[int, ...]:
        """Bases of each segment; all tokens must have a constant, positive width."""
        for t in self.tokens:
            if not t.width:
                raise PlanError(f"token {t} of a decoder must have a constant width")
        return tuple(sum(self.tokens[i].width or 0 for i, _ in parts) for parts in self.knit)

    def inputs(self) -> set[str]:
        return {self.tokens[i].segment for parts in self.knit for i, _ in parts}

    def document(self) -> dict:
        return {"token": [str(t) for t in self.tokens], "knit": [":".join("~" * r + str(i) for i, r in parts) for parts in self.knit]}


def apply(transform: Transform, source: dict[str, tuple[Column, Column]]) -> list[tuple[Column, Column]]:
    """(sequence, quality) columns of each produced segment. source: those of each input segment by number, and of corrected barcodes by letter."""
    out = []
    for parts in transform.knit:
        bases, qualities = [], []
        for i, reverse in parts:
            token = transform.tokens[i]
            if token.segment not in source:
                raise PlanError(f"token {token} reads a segment that is not there")
            s, q = (sequences.slice_column(x, token.start, token.end) for x in source[token.segment])
            bases.append(sequences.reverse_complement(s) if reverse else s)
            qualities.append(F.reverse(q) if reverse else q)
        out.append((F.concat(*bases), F.concat(*qualities)) if len(parts) > 1 else (bases[0], qualities[0]))
    return out
