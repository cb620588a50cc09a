import random

import pytest

WORDS = {
    "en": "the and that with from this water house light green winter after before river stone".split(),
    "de": "der und das mit von haus licht grün winter nach über fluß stein straße schön".split(),
    "fr": "le et que avec dans maison lumière été hiver après rivière pierre être forêt".split(),
}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars int"


def sentence(rng, n, lang="en"):
    return " ".join(rng.choice(WORDS[lang]) + (str(rng.randrange(1000)) if rng.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="session")
def frame(spark):
    """A documents frame of (doc_id, text[, lang[, source]]) rows, with extra columns whose names the operators use themselves."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", None if r[1] is None else len(r[1])) for r in rows]
        columns = COLUMNS
        if extra:
            clash = ("key", "node", "rows", "size", "tie", "copies", "language", "tokens", "license", "class_id", "spans", "a", "b", "range", "shard")
            full = [(*r, *range(len(clash))) for r in full]
            columns += "".join(f", {c} int" for c in clash)
        return spark.createDataFrame(full, columns)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and wordless texts, repeated rows, equal texts and a very long one."""
    rng = random.Random(1)
    long = sentence(rng, 30_000)
    return [
        (1, None), (2, ""), (3, " \n\t"), (4, "%%% !!! ---"), (5, "word"), (5, "word"), (6, "word"), (7, "a b c d"), (8, "東京 は 大きい 😀"), (9, long),
        (10, long), (None, "no id here at all"), (None, None), (11, "x" * 200_000), (12, "ing " * 5000), (13, "ing " * 4000), (14, "É È é è ß"), (15, "\x00\x01 nul"),
    ]
