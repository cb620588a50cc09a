import random
import re
from collections import Counter

import numpy as np
import pytest

from readloom.llm import near_duplicates as nd

from .conftest import sentence


def plain_words(text):
    return re.findall(r"[\u3000-\u9fff]|[0-9a-z\x80-\u2fff\ua000-\U0010ffff]+", "".join(c.lower() if ord(c) < 0xDF else c for c in text))


def brute(rows, similarity=0.8):
    """Classes of the smallest doc_id by comparing every pair."""
    sets = {}
    for i, t in rows:
        if i is None or t is None:
            continue
        w = plain_words(t)
        sets.setdefault(i, []).append(Counter([("text", t)] if not w else [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))]))
    by_id = {i: i for i in sets}

    def find(x):
        while by_id[x] != x:
            x = by_id[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any((x & y).total() >= similarity * (x | y).total() for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                by_id[y] = x
    return {i: find(i) for i in ids}


def variants(rng, base, n, edits):
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randint(*edits)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        yield " ".join(words)


def classes(frame, rows):
    return {r["doc_id"]: r["class_id"] for r in nd.classes(frame(rows)).collect() if r["doc_id"] is not None}


def test_against_brute_force(frame):
    rng = random.Random(8)
    texts = [sentence(rng, rng.randint(5, 200)) for _ in range(60)]
    # families of near copies, of which many are not similar to their smallest member
    for base in texts[:6]:
        texts += variants(rng, base, 25, (0, 6))
    texts += [t.upper().replace(" ", ", ") for t in texts[:10]]
    rows = list(enumerate(rng.sample(texts, len(texts))))
    assert classes(frame, rows) == brute(rows)


def test_awkward(frame, awkward):
    expected = brute([r for r in awkward])
    got = classes(frame, awkward)
    assert {i: c for i, c in got.items() if i in expected} == expected
    assert got[1] == 1
    kept = nd.one_of_each(frame(awkward), nd.classes(frame(awkward))).collect()
    ids = [r["doc_id"] for r in kept]
    assert ids.count(5) == 1 and 6 not in ids and 10 not in ids and ids.count(None) == 2
    assert classes(frame, []) == {}


@pytest.mark.parametrize("turn", [1, -1])
def test_one_doc_id_with_different_texts(frame, turn):
    rng = random.Random(5)
    x, y, z = (sentence(rng, 80) for _ in range(3))
    near = y.replace(y.split()[40], "changed", 1)
    rows = [(5, x), (5, y), (7, near), (8, z), (9, x + " end"), (9, x + " end"), (3, z)][::turn]
    assert classes(frame, rows) == {3: 3, 5: 5, 7: 5, 8: 3, 9: 5} == brute(rows)
    kept = sorted((r["doc_id"], r["text"]) for r in nd.one_of_each(frame(rows), nd.classes(frame(rows))).collect())
    assert kept == [(3, z), (5, min(x, y))]


def test_nothing_in_common(frame):
    rng = random.Random(6)
    assert classes(frame, [(i, sentence(rng, 50)) for i in range(5)]) == {i: i for i in range(5)}


@pytest.mark.parametrize("share", [0.2, 0.5, 0.9])
def test_signatures_estimate_weighted_similarity(share):
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(15):
        n = 150
        ids = rng.integers(1, 1 << 62, n).astype(np.uint64)
        one = rng.uniform(0.2, 7, n)
        two = np.where(rng.random(n) < share, one, rng.uniform(0.2, 7, n))
        s = nd.dart_signatures(np.concatenate([ids, ids]), np.repeat([0, 1], n), np.concatenate([one, two]), 2, 128)
        errors.append((s[0] == s[1]).mean() - np.minimum(one, two).sum() / np.maximum(one, two).sum())
    assert abs(np.mean(errors)) < 0.035


def test_signatures_do_not_depend_on_company():
    rng = np.random.default_rng(1)
    ids = rng.integers(1, 1 << 62, 40).astype(np.uint64)
    alone = nd.dart_signatures(ids[:10], np.zeros(10, np.int64), np.ones(10), 1, 64)
    both = nd.dart_signatures(ids, np.repeat([0, 1], [10, 30]), np.ones(40), 2, 64)
    assert (alone[0] == both[0]).all()
    assert (alone != 0).all()


def test_counted_weights(frame):
    rows = [(1, "a b c d e " * 10), (2, "a b c d e " * 11), (3, "a b c d e " * 2)]
    found = {r["doc_id"]: r["class_id"] for r in nd.classes(frame(rows), counted=False).collect()}
    assert found == {1: 1, 2: 1, 3: 1}
    assert classes(frame, rows) == {1: 1, 2: 1, 3: 3}


def test_wide_rows_are_packed(frame, monkeypatch):
    """Shingles and their counts in groups never lie in checkpoints, which are not packed."""
    rng = random.Random(21)
    shared = sentence(rng, 40)
    at_rest, steady = [], nd.common.steady
    monkeypatch.setattr(nd.common, "steady", lambda df: at_rest.append(df.columns) or steady(df))
    table, tables = nd.common.Scratch.table, []
    monkeypatch.setattr(nd.common.Scratch, "table", lambda self, df: tables.append(df.columns) or table(self, df))
    out = nd.classes(frame([(i, shared + " " + sentence(rng, 40)) for i in range(6)]), bands=26, rows=1)
    assert out.where("doc_id = class_id").count() == 6
    assert any("s0" in c for c in tables + at_rest)
    assert not any("s0" in c or "shingle" in c or "bands" in c for c in at_rest)
