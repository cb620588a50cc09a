import random
import re

import numpy as np
import pytest

from readloom.llm import mixing

from .conftest import sentence


def test_targets():
    sizes = {"a": 100, "b": 1000, "c": 1000, None: 50}
    got = mixing.targets(sizes)
    assert sum(got.values()) == pytest.approx(1.5 * 2150)
    assert all(v <= 2 * sizes[k] + 1e-9 for k, v in got.items())
    # a is full at 200 and null at 100, of weight 3 each; b and c share the rest 1 : 2
    assert got["a"] == 200 and got[None] == 100 and got["c"] == pytest.approx(1950) and got["b"] == pytest.approx(975)
    assert mixing.targets({}) == {}
    assert mixing.targets({"x": 0, "y": 10}) == {"x": 0, "y": pytest.approx(15)}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 13, 14, 15, 200, 3000])
def test_flight_keeps_totals(n):
    rng = np.random.default_rng(n)
    size = np.sort(rng.integers(0, 4000, n))[::-1]
    for p in (0.0, 0.3, 0.9, 1.0):
        start = np.full(n, p)
        moved = mixing.flight(size, start, np.random.default_rng(1), land=False)
        assert ((moved >= 0) & (moved <= 1)).all() and ((moved > 0) & (moved < 1)).sum() <= 2
        assert moved.sum() == pytest.approx(p * n) and (moved * size).sum() == pytest.approx(p * size.sum())
        landed = mixing.flight(size, start, np.random.default_rng(1), land=True)
        assert set(landed) <= {0.0, 1.0}
        if n >= 200:
            assert abs((landed * size).sum() - p * size.sum()) < 30 and abs(landed.sum() - p * n) < 12


def test_inclusion_probabilities():
    size = np.array([900, 700, 650, 500, 400, 330, 300, 250, 200, 100] * 4)
    mean = np.mean([mixing.flight(size, np.full(40, 0.4), np.random.default_rng(i), False) for i in range(600)], 0)
    assert abs(mean - 0.4).max() < 0.08


def test_operator(frame):
    rng = random.Random(4)
    rows = [(i, sentence(rng, rng.randint(1, 300)), "en", rng.choice(["s1", "s1", "s1", "s2", "S3", None])) for i in range(9000)]
    out = mixing.mix(frame(rows)).collect()
    assert len(out) == len(rows)
    words = {r[0]: len(re.findall(mixing.WORD, r[1])) for r in rows}
    sizes: dict = {}
    for i, _, _, s in rows:
        sizes[s] = sizes.get(s, 0) + words[i]
    goal = mixing.targets(sizes)
    assert mixing.WEIGHTS[0] == 3 and sorted(s for s in sizes if s) == ["S3", "s1", "s2"]
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 2
        assert r["target"] == pytest.approx(goal[r["source"]])
        taken[r["source"]] += r["size"] * r["copies"]
    for s in sizes:
        assert abs(taken[s] - goal[s]) < 0.002 * goal[s] + 5
    again = mixing.mix(frame(rows).repartition(5)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in out) == sorted((r["doc_id"], r["copies"]) for r in again)


def test_awkward(frame, awkward):
    out = mixing.mix(frame(awkward)).collect()
    assert len(out) == len(awkward) and all(0 <= r["copies"] <= 2 for r in out)
    assert mixing.mix(frame([])).count() == 0
    assert {r["copies"] for r in mixing.mix(frame([(1, None), (2, "")])).collect()} <= {0, 1, 2}


def test_very_many_equal_rows(frame):
    """Equal rows are decided one by one, in blocks like other rows."""
    rows = [(1, "one two three", "en", "hot")] * 9000 + [(i, "a b " * (i % 7), "en", "cold") for i in range(2, 500)]
    out = mixing.mix(frame(rows)).collect()
    assert len(out) == len(rows)
    for source in ("hot", "cold"):
        mine = [r for r in out if r["source"] == source]
        taken = sum(r["size"] * r["copies"] for r in mine)
        assert abs(taken - mine[0]["target"]) <= 6 and all(r["copies"] <= 2 for r in mine)
    again = mixing.mix(frame(rows[::-1])).collect()
    assert sorted((r["doc_id"], r["tie"], r["copies"]) for r in out) == sorted((r["doc_id"], r["tie"], r["copies"]) for r in again)
