"""Document fingerprints by consistent weighted sampling.

A text is a weighted set of terms (its words, weighted by how often they occur; a text without a word is one term). For each of K samples, a hash
of sample and term gives the term two gamma(2, 1) variables r and c and a uniform b, the same wherever the
term occurs. With t = floor(ln w / r + b), the term's level, its sampling value is ln c - r (t - b + 1); the
term of the smallest value, with its level, is the sample. Two texts agree in a sample with the chance of
their generalised Jaccard similarity (sum of smaller weights over sum of larger). The value itself stands for
the term and level, as it depends on nothing else.

Gamma variables are sums of two negative logarithms of uniforms, read from a table of 2^16 steps. Values are
computed once for each distinct (term, weight) of a batch, then the smallest of each text is taken.

A fingerprint is K samples of 16 bits in hexadecimal. Defined results: a null or empty text has the fingerprint of
zeros; likeness of two such is 1.0, of one such and another text 0.0; equal texts have equal fingerprints; a text of
any length is read whole.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np

from readloom.llm import common

SAMPLES = 64
#: (term, weight) pairs whose values are computed at once.
_AT_ONCE = 4096


@functools.lru_cache(1)
def _logs() -> np.ndarray:
    """-ln of the middle of each of 2^16 steps of (0, 1)."""
    return -np.log((np.arange(1 << 16) + 0.5) / (1 << 16))


@functools.lru_cache(4)
def _salts(k: int) -> np.ndarray:
    return common.mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def sampling_values(term: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """(n, k): ln c - r (t - b + 1) of each term hash at its weight."""
    logs, low = _logs(), np.uint64(0xFFFF)
    one = common.mix(term[:, None] ^ _salts(k))
    two = common.mix(one)
    r = logs[one & low] + logs[one >> np.uint64(16) & low]
    c = logs[one >> np.uint64(32) & low] + logs[one >> np.uint64(48)]
    b = (two >> np.uint64(11)) / float(1 << 53)
    t = np.floor(np.log(weight)[:, None] / r + b)
    return np.log(c) - r * (t - b + 1)


def signatures(texts: common.Texts, k: int = SAMPLES) -> np.ndarray:
    """(n, k) samples of 16 bits; zeros for an empty text."""
    words = common.Words(texts)
    term, owner, count = common.unique_grams(words.hash, words.text)
    wordless = np.flatnonzero((words.counts == 0) & (np.diff(texts.offsets) > 0))
    if len(wordless):
        whole = [hashlib.blake2b(texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes(), digest_size=8).digest() for i in wordless]
        term = np.concatenate([term, np.frombuffer(b"".join(whole), np.uint64)])
        owner, count = np.concatenate([owner, wordless]), np.concatenate([count, np.ones(len(wordless), np.int64)])
        order = np.argsort(owner, kind="stable")
        term, owner, count = term[order], owner[order], count[order]
    out = np.zeros((len(texts), k), np.uint16)
    if not len(term):
        return out
    # number the distinct (term, count) pairs
    with np.errstate(over="ignore"):
        tagged = term * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64)
    _, at, pair = np.unique(tagged, return_index=True, return_inverse=True)
    values = np.empty((len(at), k))
    for i in range(0, len(at), _AT_ONCE):
        some = at[i : i + _AT_ONCE]
        values[i : i + _AT_ONCE] = sampling_values(term[some], count[some].astype(float), k)
    size = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(size) - size
    for i in np.flatnonzero(size):
        best = values[pair[first[i] : first[i] + size[i]]].min(0)
        out[i] = (common.mix(best.view(np.uint64)) % np.uint64(0xFFFF) + np.uint64(1)).astype(np.uint16)
    return out


def to_hex(signature: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in signature.astype(">u2")]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of samples in which rows agree."""
    return (a == b).mean(1)
