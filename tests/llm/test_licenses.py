import random
import re

import pytest

from readloom.llm import licenses


def brute(text):
    """Base places by looking at every word."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(k, label) for phrase, label in licenses.BASE_PHRASES.items() for p in [phrase.split()] for k in range(len(words)) if words[k : k + len(p)] == p]
    return len(words), sorted(places)


def test_base_places_against_brute_force(awkward):
    rng = random.Random(1)
    pieces = ["cc", "by", "CC BY", "general", "Public", "license", "all rights", "reserved", "rights", "x", "é", "cc-by", "\n", ",", "  ", "copyright", "gnu"]
    texts = [rng.choice(["", " "]).join(rng.choice(pieces) + rng.choice([" ", "-", ""]) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    for t in [*texts, *(t for _, t in awkward), None]:
        n, places = brute(t)
        got = licenses.scan(t)
        assert (got["n_words"], got["n_base"]) == (n, len(places)), t
        assert (got["first_word"], got["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None)), t
        assert got["base_labels"] == sorted({x for _, x in places}) and set(got["base_labels"]) <= set(got["labels"])
        assert 0 <= got["score"] <= 1


@pytest.mark.parametrize(
    ("expression", "names", "allowed"),
    [
        ("MIT", ["mit"], True), ("GPL-2.0-only", ["gpl-2.0-only"], False), ("MIT OR GPL-2.0-only", ["mit", "gpl-2.0-only"], True), ("MIT AND GPL-2.0-only", ["mit", "gpl-2.0-only"], False),
        ("GPL-2.0-only OR MIT AND ISC", ["gpl-2.0-only", "mit", "isc"], True), ("(GPL-2.0-only OR MIT) AND GPL-3.0", ["gpl-2.0-only", "mit", "gpl-3.0"], False),
        ("Apache-2.0 WITH LLVM-exception", ["apache-2.0", "llvm-exception"], True), ("MIT OR", ["mit"], False), ("(MIT", ["mit"], False), ("", [], False), (") MIT", ["mit"], False), ("MIT */ more prose", ["mit"], True),
    ],
)
def test_expressions(expression, names, allowed):
    assert licenses.evaluate(expression) == (names, allowed)


def test_postfix_precedence():
    assert licenses.postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert licenses.postfix("(a or b) and c") == ["a", "b", "or", "c", "and"]


def test_tags_and_notices():
    got = licenses.scan("// SPDX-License-Identifier: MIT OR (Apache-2.0 AND GPL-3.0)\nPermission is hereby granted, free of charge\nCopyright X")
    assert got["expressions"] == [{"expression": "mit or (apache-2.0 and gpl-3.0)", "identifiers": ["mit", "apache-2.0", "gpl-3.0"], "permitted": True}]
    assert got["labels"] == sorted(["mit", "copyright", "spdx:mit", "spdx:apache-2.0", "spdx:gpl-3.0", "spdx-permitted"]) and got["score"] > 0.98


def test_operator(frame, awkward):
    df = frame(awkward)
    out = licenses.license_scan(df)
    assert out.columns == [*df.columns, "license_"] and out.count() == len(awkward)
    assert licenses.license_scan(frame([])).count() == 0
    r = licenses.license_scan(frame([(1, "All rights reserved. All rights reserved.")])).first()["license_"]
    assert (r["n_base"], r["first_word"], r["last_word"], r["labels"]) == (2, 0, 3, ["reserved"])


def test_expressions_over_lines_and_malformed_ones():
    (found,) = licenses.scan("# SPDX-License-Identifier: (MIT OR\n# Apache-2.0)\n# some prose")["expressions"]
    assert found["identifiers"] == ["mit", "apache-2.0"] and found["permitted"]
    got = licenses.scan("SPDX-License-Identifier: GPL-2.0-only OR\r\nMIT\r\nprose")
    assert {"spdx:gpl-2.0-only", "spdx:mit", "spdx-permitted"} <= set(got["labels"])
    (found,) = licenses.scan("SPDX-License-Identifier: MIT\nor so")["expressions"]
    assert found["expression"] == "mit" and found["identifiers"] == ["mit"]
    assert licenses.evaluate("(MIT OR Apache-2.0 AND ISC") == (["mit", "apache-2.0", "isc"], False)
    assert licenses.evaluate("(MIT OR Apache-2.0 and some prose behind") == (["mit", "apache-2.0", "some"], False)


def test_punctuation_quotes_and_later_versions():
    def found(text):
        ((e,),) = [licenses.scan(text)["expressions"]]
        return e["identifiers"], e["permitted"]

    assert found("SPDX-License-Identifier: MIT. See file") == (["mit"], True)
    assert found('{"SPDX-License-Identifier": "Apache-2.0 OR GPL-2.0+", "x": 1}') == (["apache-2.0", "gpl-2.0+"], True)
    assert found("# SPDX-License-Identifier : (ISC AND Apache-2.0+)") == (["isc", "apache-2.0+"], True)
    assert found("SPDX-License-Identifier: LicenseRef-own-1.0, and more") == (["licenseref-own-1.0"], False)
    assert found("SPDX-License-Identifier: DocumentRef-a:LicenseRef-b") == (["documentref-a:licenseref-b"], False)
    assert licenses.scan("spdx-license-identifier")["expressions"] == []
