import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import language_id as li

from .conftest import sentence


def labelled(seed, n=60, length=(20, 80)):
    rng = random.Random(seed)
    return [(sentence(rng, rng.randint(*length), lang), lang) for lang in ("en", "de", "fr") for _ in range(n)]


@pytest.fixture(scope="module")
def chain():
    return li.fit(labelled(1))


def test_held_out_accuracy(chain):
    rows = labelled(2, 40)
    found = li.predict(chain, [t for t, _ in rows])
    assert np.mean([f["lang"] == lang for f, (_, lang) in zip(found, rows, strict=True)]) > 0.98
    assert all(0 <= f["score"] <= 1 for f in found)


def test_code_switched_words(chain):
    rng = random.Random(3)
    (found,) = li.predict(chain, [sentence(rng, 40, "en") + ". " + sentence(rng, 40, "fr")], True)
    truth = ["en"] * 40 + ["fr"] * (len(found["words"]) - 40)
    assert np.mean([a == b for a, b in zip(found["words"], truth, strict=True)]) > 0.9


def test_blocks_give_the_whole_chains_posteriors(chain):
    rng = np.random.default_rng(4)
    counts = np.array([1, 0, 31, 32, 33, 64, 200, 5])
    e = rng.uniform(1e-6, 1, (counts.sum(), 3))
    got = chain.label_words(e, counts)
    at = 0
    for n in counts:
        part, a = e[at : at + n], chain.factors
        forward, backward = [np.full(3, 1 / 3)], [np.ones(3)]
        for x in part:
            f = forward[-1] @ a * x
            forward.append(f / f.sum())
        for x in part[:0:-1]:
            b = a @ (x * backward[-1])
            backward.append(b / b.sum())
        if n:
            truth = np.array(forward[1:]) * np.array(backward[::-1])
            assert np.allclose(got[at : at + n], truth / truth.sum(1, keepdims=True))
        at += n


def test_gradient_moves_transitions(chain):
    off = chain.factors[~np.eye(3, dtype=bool)]
    assert (np.diag(chain.factors) > off.max()).all()  # labels cling together, as learned


def test_operator(frame, awkward):
    rows = [(100 + i, t, lang) for i, (t, lang) in enumerate(labelled(5, 25))]
    df = frame(rows)
    fitted = li.learn(df, li.held_in(F.col("doc_id")))
    assert fitted.labels == ["de", "en", "fr"]
    out = li.identify(df, fitted, into="language")
    assert out.columns == [*df.columns, "language_"]  # the name is taken
    assert out.where("language_.lang = lang").count() >= 0.95 * len(rows)
    odd = {i: r for i, r in enumerate(li.predict(fitted, [t for _, t in awkward]))}
    for i, (_, t) in enumerate(awkward):
        if t is None or not any(c.isalpha() for c in t):
            assert odd[i]["lang"] == "und" and odd[i]["score"] == 0.0
        else:
            assert odd[i]["lang"] in fitted.labels
    assert li.identify(frame([]), fitted).count() == 0
    assert li.learn(frame([]), F.lit(True)) is None
    assert {r["language_"]["lang"] for r in li.identify(df, None).collect()} == {"und"}


def test_prediction_reads_nothing_else(frame):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(labelled(6, 20))]
    fitted = li.learn(frame(rows), li.held_in(F.col("doc_id")))
    hidden = [(r[0] + 5000, r[1], None, None) for r in rows]
    one = [r["language_"] for r in li.identify(frame(rows), fitted).orderBy("doc_id").collect()]
    two = [r["language_"] for r in li.identify(frame(hidden), fitted).orderBy("doc_id").collect()]
    assert one == two


def test_windows_reach_the_end_of_a_long_text(frame):
    rng = random.Random(12)
    rows = [(i, sentence(rng, 6000) + " " + " ".join(["finale"] * 400), "en") for i in range(4)] + [(i + 10, sentence(rng, 50, "fr"), "fr") for i in range(4)]
    assert "finale" in li.learn(frame(rows), F.lit(True)).lexicon


def test_every_label_is_learnt(frame, spark):
    """However many languages there are, and however rare one is."""
    rng = random.Random(11)
    words = {f"l{k}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(4)) + chr(97 + k % 26) + chr(97 + k // 26) for _ in range(12)] for k in range(210)}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(40)), k) for i, k in enumerate([k for k in words for _ in range(3)])]
    df = frame(rows)
    chain = li.learn(df, F.lit(True))
    assert chain.labels == sorted(words)


def test_scripts_without_spaces_and_long_words():
    assert li.sample("東京abcです x" + "y" * 50) == ["東", "京", "abc", "で", "す", "x" + "y" * 23, "y" * 24, "yyy"]
