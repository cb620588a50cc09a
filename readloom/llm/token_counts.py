"""Token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary match of a word; a dynamic programme carries, for each
position, the best score and the number of pieces, never the pieces themselves. Ties go by the tokenizer's
rule: matches that end at a position compete in order of their start, and a later one must be strictly better.
A code point without a match of its own may also be an unknown piece (the lowest score less 10); with byte
fallback it counts one token a byte.

The vocabulary is a public tokenizer's list of pieces with scores, read as a unigram model. Spaces become the
word mark and one mark is put before the text. No piece has a mark behind another character, so the best path
of a text is the best paths of its marked words one after the other, and words are counted once and remembered
(scores are whole numbers, so that sums are exact in any order). Where a vocabulary breaks either condition,
whole texts are the unit instead.

Defined results: null text: null count; empty text: 0; a text of any length is read whole; repeated rows get equal
results; an empty table gives no rows; other columns pass unchanged, and the new one's name gives way to theirs.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import common

MARK = "▁"
#: Below the lowest score of the vocabulary; fixed by the tokenizer.
UNKNOWN_PENALTY = 10.0
#: Words remembered by a worker before it starts afresh (a few dozen MB).
REMEMBERED = 150_000


class Unigram:
    """vocabulary: (piece, score) in order of ids."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.bytes = byte_fallback
        self.by_word = not any(MARK in p.lstrip(MARK) for p, _ in vocabulary) and all(s == int(s) for _, s in vocabulary)
        self.known: dict[str, tuple[int, float]] = {}
        self.single = {p for p, _ in vocabulary if len(p) == 1}

    def _path(self, word: str) -> tuple[int, float]:
        """Tokens and score of the best path. Unknown pieces that touch count as one without byte fallback."""
        n = len(word)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        open_unknown = [False] * (n + 1)
        single, fallback = self.single, self.bytes
        matches = self.automaton.iter(word)
        end, (length, score) = next(matches, (n, (0, 0.0)))
        for at in range(n):
            to = at + 1
            top = None
            while end == at:  # the automaton lists the longest match of an end first
                s = best[to - length] + score
                if top is None or s > top:
                    top, count[to], open_unknown[to] = s, count[to - length] + 1, False
                end, (length, score) = next(matches, (n, (0, 0.0)))
            c = word[at]
            if c not in single:
                s = best[at] + self.unknown
                if top is None or s > top:
                    top = s
                    count[to] = count[at] + (len(c.encode("utf-8", "surrogatepass")) if fallback else not open_unknown[at])
                    open_unknown[to] = True
            best[to] = top
        return int(count[n]), best[n]

    def count(self, text: str) -> tuple[int, float]:
        """Tokens and best score of a text."""
        if not text:
            return 0, 0.0
        marked = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return self._path(marked)
        tokens, total, known = 0, 0.0, self.known
        # a run of marks belongs before the word that follows it
        for word in re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", marked):
            found = known.get(word)
            if found is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = self._path(word)
                if len(word) < 64:
                    known[word] = found
            tokens += found[0]
            total += found[1]
        return tokens, total


def pieces(path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


@functools.lru_cache(2)
def load(path: str, byte_fallback: bool) -> Unigram:
    return Unigram(pieces(path), byte_fallback)


def _counter(path: str, byte_fallback: bool) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    kind = pa.struct([("n_tokens", pa.int64()), ("score", pa.float64())])

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load(path, byte_fallback)
        for column in common.tidy(columns):
            found = [None if t is None else model.count(t) for t in column.to_pylist()]
            yield pa.array([None if x is None else {"n_tokens": x[0], "score": x[1]} for x in found], kind)

    return run


def token_counts(docs: DataFrame, path: str, text: str = "text", byte_fallback: bool = True, into: str = "tokens") -> DataFrame:
    """docs with one more column: a struct of n_tokens (long) and score (double). Other columns stay as they are."""
    counter = F.arrow_udf(_counter(path, byte_fallback), "struct<n_tokens:long,score:double>")
    return docs.withColumn(common.free_name(docs, into), counter(docs[text]))
