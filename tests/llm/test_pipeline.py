import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from readloom.llm import mixing  # noqa: E402

from .conftest import sentence  # noqa: E402


@pytest.fixture(scope="module")
def folder(frame, awkward, tmp_path_factory):
    rng = random.Random(9)
    shared = sentence(rng, 80)
    rows = [(i, sentence(rng, rng.randint(20, 150), lang) + (" " + shared if i % 10 == 0 else ""), lang, rng.choice("ab")) for i, lang in enumerate(["en", "de", "fr"] * 50)]
    rows += [(1000 + i, rows[i][1], rows[i][2], "c") for i in range(20)] + [(2000, "1234 %%%", "en", "a")] + [(3000 + (i or 0), t, "en", "odd") for i, t in awkward]
    where = tmp_path_factory.mktemp("corpus")
    frame(rows).write.parquet(str(where / "documents.parquet"))
    return str(where), rows


def test_stages(spark, folder):
    where, rows = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "MinHash near-dedup", "substring dedup", "mixing sources to target weights", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, where)
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
    language, near, substring, mixed, packed = kept.values()
    clean = {r[0] for r in rows if r[0] < 150}
    assert clean <= {r["doc_id"] for r in language} and 2000 not in {r["doc_id"] for r in language}
    assert {r["doc_id"] for r in near} >= clean and not {r["doc_id"] for r in near} & set(range(1000, 1020))
    texts = {r[0]: r[1] for r in rows}
    assert {r["doc_id"] for r in substring} >= clean
    for r in substring:
        if r["doc_id"] in clean:
            assert (r["text"] == texts[r["doc_id"]]) == (r["doc_id"] % 10 != 0 or r["doc_id"] == 0)
    sizes: dict = {}
    for r in substring:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    taken: dict = {}
    for r in mixed:
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
    for s, goal in mixing.targets(sizes).items():
        assert s == "odd" or taken.get(s, 0) == pytest.approx(goal, rel=0.02)
    assert sum(r["length"] for r in packed) >= sum(taken.values())


def test_run_and_empty(spark, folder, frame, tmp_path):
    where, _ = folder
    assert corpus_pipeline.run(spark, where).count() > 0
    frame([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
