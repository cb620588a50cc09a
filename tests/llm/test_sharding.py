import random
import zlib
from collections import defaultdict

from readloom.llm import sharding

from .conftest import sentence


def check(rows, out, n=8):
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in out) == sorted((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in out:
        assert 0 <= r["shard"] < n
        slots[r["shard"]].append(r["slot"])
    for v in slots.values():
        assert sorted(v) == list(range(len(v)))
    size = defaultdict(int)
    for r in out:
        size[r["shard"]] += r["size"]
    return [size[k] for k in range(n)]


def test_balance_and_groups(frame):
    rng = random.Random(1)
    texts = [sentence(rng, rng.randint(1, 120)) for _ in range(3000)]
    rows = list(enumerate(texts + rng.choices(texts, k=200)))
    out = sharding.shards(frame(rows), 8).collect()
    sizes = check(rows, out)
    assert max(sizes) < 1.05 * sum(sizes) / 8 and min(sizes) > 0.95 * sum(sizes) / 8
    shard = defaultdict(set)
    by_id = dict(rows)
    for r in out:
        shard[by_id[r["doc_id"]]].add(r["shard"])
    assert all(len(v) == 1 for v in shard.values())
    assert sorted(map(tuple, out)) == sorted(map(tuple, sharding.shards(frame(rows), 8).collect()))


def test_a_hot_group_is_divided(frame):
    rng = random.Random(2)
    rows = [(i, "the same text " * 20) for i in range(1500)] + [(5000 + i, sentence(rng, 40)) for i in range(1500)] + [(9999, "one row many times " * 10)] * 600
    sizes = check(rows, sharding.shards(frame(rows), 8).collect())
    assert max(sizes) < 1.1 * sum(sizes) / 8


def test_awkward(frame, awkward):
    check(awkward, sharding.shards(frame(awkward), 8).collect())
    check([(1, "x")], sharding.shards(frame([(1, "x")]), 8).collect())
    assert sharding.shards(frame([]), 8).count() == 0


def test_a_text_that_fills_most_of_a_range_is_parted_at_once():
    """One round parts the copies of a text from all texts behind them, the next divides the copies."""
    copies, others = [(1, i, 0) for i in range(30)], [(k, 0, 0) for k in range(2, 12)]
    assert sharding._quantiles(copies + others, 2) == [(2, sharding._LOWEST, sharding._LOWEST)]
    assert sharding._quantiles(copies, 2) == [(1, 15, 0)]
