import random
import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from readloom.llm import common, graph


def test_words_against_plain_python():
    import re

    rng = random.Random(2)
    texts = ["".join(rng.choice("abAB 9é É.\n東-") for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", None, "x"]
    words = common.Words(common.Texts(texts))
    seen: dict[str, int] = {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        expected = [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[\xe4-\xe9]..|(?:(?![\xe4-\xe9])[0-9A-Za-z\x80-\xff])+", raw)]
        at = slice(words.first[i], words.first[i + 1])
        base = words.texts.offsets[i]
        assert [(s - base, e - base) for s, e in zip(words.start[at], words.end[at], strict=True)] == [(s, e) for s, e, _ in expected]
        for h, (_, _, w) in zip(words.hash[at], expected, strict=True):
            folded = "".join(c.lower() if ord(c) < 0xDF else c for c in w.decode())
            assert seen.setdefault(folded, int(h)) == int(h)
    assert len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_the_batch():
    texts = ["alpha beta gamma delta", "beta gamma delta epsilon zeta", "one", ""]
    whole = common.Words(common.Texts(texts)).grams(3, True)
    parts = [common.Words(common.Texts([t])).grams(3, True)[0] for t in texts]
    assert whole[0].tolist() == np.concatenate(parts).tolist()
    sliced = pa.array(["skip", *texts]).slice(1)
    assert common.Words(common.Texts(sliced)).grams(3, True)[0].tolist() == whole[0].tolist()


def test_slices():
    batch = pa.record_batch([pa.array(["aaaa", None, "bb", "c" * 50, ""])], ["t"])
    parts = [b.column(0).to_pylist() for b in common.slices([batch], "t", 6)]
    assert parts == [["aaaa", None, "bb"], ["c" * 50], [""]] or [x for p in parts for x in p] == batch.column(0).to_pylist()


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(50)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["class"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in links)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_result_lets_go_of_exchanges(spark):
    """Exchanges that nobody reads any more do not stay until the driver happens to collect its garbage."""

    def exchanges():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return set(re.findall(r"shuffle_\d+_", blocks.toString()))

    before = exchanges()
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().write.format("noop").mode("overwrite").save()
    assert (made := exchanges() - before)
    common.Scratch().result(spark.range(3))
    for _ in range(50):
        if not made & exchanges():
            break
        time.sleep(0.1)
    assert not made & exchanges()
