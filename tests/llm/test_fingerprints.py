import hashlib
import random

import numpy as np
import pytest

from readloom.llm import common, fingerprints, neighbours

from .conftest import sentence


@pytest.mark.parametrize("same", [0.2, 0.6, 0.95])
def test_collisions_estimate_similarity(same):
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(12):
        one = rng.integers(0, 9, 120)
        two = np.where(rng.random(120) < same, one, rng.integers(0, 9, 120))
        texts = [" ".join(f"w{i}" for i, n in enumerate(w) for _ in range(n)) for w in (one, two)]
        s = fingerprints.signatures(common.Texts(texts), 512)
        errors.append(fingerprints.likeness(s[:1], s[1:])[0] - np.minimum(one, two).sum() / np.maximum(one, two).sum())
    assert abs(np.mean(errors)) < 0.02


def test_against_plain_sampling():
    """Per text and sample, the smallest value over its terms, one at a time."""
    texts = ["a b b c c c", "c c c b", "a", "", "É é x"]
    words = common.Words(common.Texts(texts))
    got = fingerprints.signatures(common.Texts(texts), 16)
    for i in range(len(texts)):
        h, n = np.unique(words.hash[words.first[i] : words.first[i + 1]], return_counts=True)
        if not len(h):
            assert not got[i].any()
            continue
        best = np.min([fingerprints.sampling_values(h[j : j + 1], n[j : j + 1].astype(float), 16)[0] for j in range(len(h))], 0)
        assert (got[i] == (common.mix(best.view(np.uint64)) % np.uint64(0xFFFF) + np.uint64(1)).astype(np.uint16)).all()


def expected(rows):
    order = sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        cut = t[: len(t) - half] + following[:half]
        own, edited, after = fingerprints.signatures(common.Texts([t, cut, following]))
        out[i] = (len(t), hashlib.sha256(cut.encode()).hexdigest(), *fingerprints.to_hex(np.array([own, edited])), (own == edited).mean(), (own == after).mean())
    return out


@pytest.mark.parametrize("range_bytes", [1 << 24, 3000])
def test_operator(frame, monkeypatch, range_bytes):
    monkeypatch.setattr(neighbours, "RANGE_BYTES", range_bytes)
    rng = random.Random(6)
    rows = [(i * 7 % 1009 - 300, sentence(rng, rng.randint(0, 60), rng.choice(["en", "de", "fr"]))) for i in range(300)]
    rows += [(5000, None), (5001, ""), (None, "first of all"), (6000, rows[0][1]), (7000, "東京😀 é" * 50)]
    out = neighbours.fingerprint_neighbours(frame(rows)).collect()
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in out}
    assert len(out) == len(rows) and got == expected(rows)
    assert got[6000][2] == got[rows[0][0]][2]


def test_awkward(frame, awkward):
    out = neighbours.fingerprint_neighbours(frame(awkward)).collect()
    assert len(out) == len(awkward)
    prints = {r["doc_id"]: r["fingerprint"] for r in out}
    assert prints[1] == prints[2] == "0" * 256 and len({prints[i] for i in (2, 3, 4, 5)}) == 4
    (one,) = neighbours.fingerprint_neighbours(frame([(3, "abcd")])).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0
    assert neighbours.fingerprint_neighbours(frame([])).count() == 0


def test_one_doc_id_holds_most_rows(frame, monkeypatch):
    """Rows with one doc_id, and equal rows, are divided into ranges like others."""
    monkeypatch.setattr(neighbours, "RANGE_BYTES", 500)
    rng = random.Random(7)
    rows = [(None, sentence(rng, 20)) for _ in range(80)] + [(7, "the same text " * 5)] * 80 + [(9, "last")]
    out = neighbours.fingerprint_neighbours(frame(rows)).collect()
    assert len(out) == len(rows)
    inside = [r for r in out if r["doc_id"] == 7]
    assert sorted(r["near_next"] for r in inside)[1:] == [1.0] * 79
    text = "the same text " * 5
    half = len(text) // 2
    assert sum(r["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + text[:half]).encode()).hexdigest() for r in inside) == 79
    assert {r["doc_id"]: r["near_next"] for r in out}[9] < 1.0
