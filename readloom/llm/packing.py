"""Harmonic packing of tokenised documents into sequences.

Lengths fall into reciprocal-capacity classes: class j holds pieces of (C/(j+1), C/j] tokens, and a bin of
class j is full with j pieces, whatever they are, so that each worker fills its bins on its own with one open
bin a class and no search. A document is first cut into whole sequences; what is left is one piece if it
nearly fills its class (at most SLACK of the class's share is lost), else a piece of exactly C/(j+1) tokens is
cut off, and the rest goes the same way. When a worker ends, the pieces of its open bins are laid end to end,
cut where a sequence is full, so that only its last sequence is short. Tokens never leave the worker: the plan
is one pass over the documents without a shuffle.

Ids are those that `tokenizers` gives for the file (add_special_tokens=False), followed by one end id a document; the
string of a special token in a text becomes that token's id. They are computed by a faster library from the same
file's vocabulary; as its pattern engine recurses over runs of white space and gives up on very long ones, texts with
such runs go to `tokenizers` itself. Both give the same ids.

Defined results: null and empty texts are the end id alone; repeated rows are packed each; doc_id may be null; an
empty table gives no rows; a text of any length is tokenised whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from readloom.llm import common

#: Tokens of a sequence.
CAPACITY = 1024
#: What a piece may fall short of its class's share.
SLACK = 1 / 48
#: White space in a row from which a text goes to the slower library.
LONG_SPACE = 5000
#: Bits of a sequence's number within its partition.
LOCAL_BITS = 40

_SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@functools.lru_cache(2)
def _reference(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(2)
def encoder(path: str):
    """Text to an array of ids, by the vocabulary of a byte-level BPE tokenizer file."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    # the 256 byte symbols: printable Latin-1 stands for itself, the rest follow from U+0100 in order
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in model.get("added_tokens", ())}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        if len(text) > LONG_SPACE and re.search(rf"\s{{{LONG_SPACE}}}", text):  # too deep for the fast library's pattern engine
            return np.array(_reference(path).encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(fast.encode(text, allowed_special="all"), "<u4")

    return encode


def cuts(length: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Lengths of the pieces of a document, in order."""
    pieces = [capacity] * (length // capacity)
    left = length % capacity
    while left:
        per_bin = capacity // left
        slot = capacity // per_bin
        if slot - left <= max(0, int(slot * slack)):
            pieces.append(left)
            break
        piece = capacity // (per_bin + 1)
        pieces.append(piece)
        left -= piece
    return pieces


class Packer:
    """Bins of one worker. add() and finish() give (document, start, length, sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY, slack: float = SLACK):
        self.capacity, self.slack = capacity, slack
        self.next = 0
        self.open: dict[int, list[tuple]] = {}

    def add(self, document, length: int) -> list[tuple]:
        placed, start = [], 0
        for piece in cuts(length, self.capacity, self.slack):
            per_bin = self.capacity // piece
            waiting = self.open.setdefault(per_bin, [])
            waiting.append((document, start, piece))
            start += piece
            if len(waiting) == per_bin:
                offset = 0
                for d, s, n in waiting:
                    placed.append((d, s, n, self.next, offset))
                    offset += n
                self.next += 1
                waiting.clear()
        return placed

    def finish(self) -> list[tuple]:
        placed, offset = [], 0
        for per_bin in sorted(self.open):
            for d, s, n in self.open[per_bin]:
                while n:
                    take = min(n, self.capacity - offset)
                    placed.append((d, s, take, self.next, offset))
                    s, n, offset = s + take, n - take, offset + take
                    if offset == self.capacity:
                        self.next, offset = self.next + 1, 0
        self.open.clear()
        self.next += offset > 0
        return placed


def pack(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, slack: float = SLACK, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start (ids before it), length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id and offset in the sequence."""
    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def rows(placed: list[tuple], first: int) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in kind]
        for (name, ids), start, length, sequence, offset in placed:
            for column, value in zip(columns, (name, start, length, ids[start : start + length].tobytes(), len(ids), first + sequence, offset), strict=True):
                column.append(value)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    def run(batches):
        encode = encoder(path)
        packer = Packer(capacity, slack)
        first = TaskContext.get().partitionId() << LOCAL_BITS
        end = np.array([end_id], "<u4")
        for batch in common.slices(batches, "text"):
            placed = []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encode(body.as_py() or ""), end])
                placed += packer.add((name, ids), len(ids))
            yield rows(placed, first)
        yield rows(packer.finish(), first)

    return narrow.mapInArrow(common.freed(run), "doc_id long, " + _SCHEMA)
