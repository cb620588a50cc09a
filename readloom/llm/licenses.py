"""License scans: an Aho-Corasick automaton finds identifier tags and notice phrases; a shunting-yard parser evaluates licence expressions.

Texts are lower-cased (A-Z only) and read as words, runs of [0-9a-z] and of everything from U+0080 up. The
automaton runs over the words joined by single spaces, so that a phrase matches whatever stands between its
words. Where it meets an identifier tag, the expression behind the tag (`mit or (gpl-2.0-only with x and y)`)
is read from the text as it stands, put into postfix order by precedence (with, and, or) and evaluated: an `or`
is permitted where a side is, an `and` where both are, and a `with` follows its licence.

Punctuation that ends an identifier (`MIT.`) does not belong to it, a tag and its expression may stand in quotes, and
`+` after an identifier stands for later versions and changes nothing in what is permitted.

Defined results: null and empty texts have no word and no label; repeated rows get equal results; an empty table gives
no rows; other columns pass unchanged, and the new one's name gives way to theirs; places may overlap and each counts; a
malformed expression (operators without operands, open parentheses) gives its identifiers but is not permitted. An
expression ends at its line unless a parenthesis or an operator is open there.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import common

#: Phrases whose places are counted, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of the method: label and the weight of one such notice as evidence of a licence statement.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge": ("mit", 0.9),
    "mit license": ("mit", 0.8),
    "released under the mit": ("mit", 0.8),
    "permission to use copy modify and or distribute this software": ("isc", 0.9),
    "isc license": ("isc", 0.8),
    "apache license": ("apache", 0.8),
    "licensed under the apache license": ("apache", 0.9),
    "apache software license": ("apache", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "bsd license": ("bsd", 0.8),
    "neither the name of": ("bsd", 0.5),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "common development and distribution license": ("cddl", 0.9),
    "european union public licence": ("eupl", 0.9),
    "boost software license": ("boost", 0.9),
    "artistic license": ("artistic", 0.8),
    "zlib license": ("zlib", 0.8),
    "python software foundation license": ("psf", 0.9),
    "open database license": ("odbl", 0.9),
    "sil open font license": ("ofl", 0.9),
    "lesser general public license": ("lgpl", 0.9),
    "library general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "gnu free documentation license": ("gfdl", 0.9),
    "do what the fuck you want to public license": ("wtfpl", 0.9),
    "business source license": ("busl", 0.9),
    "server side public license": ("sspl", 0.9),
    "creative commons": ("creative-commons", 0.7),
    "creative commons attribution": ("cc-by", 0.8),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nc": ("cc-by-nc", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc by nc sa": ("cc-by-nc-sa", 0.8),
    "cc by nc nd": ("cc-by-nc-nd", 0.8),
    "cc0": ("cc0", 0.8),
    "unlicense": ("unlicense", 0.8),
    "released into the public domain": ("public-domain", 0.8),
    "public domain": ("public-domain", 0.5),
    "proprietary and confidential": ("proprietary", 0.9),
    "do not distribute": ("proprietary", 0.6),
    "unauthorized copying of this file": ("proprietary", 0.9),
    "used with permission": ("permission", 0.5),
    "copyright": ("copyright", 0.4),
}
#: Words of an identifier tag, and the pattern of the tag with its expression in the text.
TAG = "spdx license identifier"
_TAG_TEXT = re.compile(rb"spdx-license-identifier[\"']?[ \t]*:[ \t]*(?:(?P<quote>[\"'])(?P<quoted>[^\r\n\"']*)(?P=quote)|(?P<open>[^\r\n]*))")
_NEXT_LINE = re.compile(rb"(?:\r\n|\r|\n)([^\r\n]*)")
_TOKEN = re.compile(rb"\(|\)|[0-9a-z](?:[0-9a-z.+:-]*[0-9a-z+])?")
_SENTENCE = re.compile(rb"[,;]|\.\s")
#: Binding strength of the operators of an expression.
PRECEDENCE = {"with": 3, "and": 2, "or": 1}
#: Identifiers taken as permitted when no others are given.
PERMITTED = frozenset(
    "0bsd afl-3.0 apache-1.1 apache-2.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsl-1.0 cc-by-3.0 cc-by-4.0 cc-pddc cc0-1.0 ecl-2.0 fsfap hpnd isc "
    "libpng-2.0 mit mit-0 ms-pl mulanpsl-2.0 ncsa odc-by-1.0 ofl-1.1 openssl pddl-1.0 php-3.01 postgresql psf-2.0 python-2.0 ruby ssh-short tcl unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 xnet zlib zpl-2.1".split()
)
BASE_WEIGHT = 0.7


def _tokens(expression: str) -> list[str]:
    """Identifiers, operators and parentheses, up to a comma, a semicolon or the end of a sentence."""
    return [t.decode() for t in _TOKEN.findall(_SENTENCE.split(expression.encode(), maxsplit=1)[0])]


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order, None where the expression is malformed."""
    output: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in _tokens(expression):
        if token in PRECEDENCE:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                output.append(stack.pop())
            stack.append(token)
            operand_next = True
        elif token == "(":
            if not operand_next:
                return None
            stack.append(token)
        elif token == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                output.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not operand_next:
                break  # prose behind the expression
            output.append(token)
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return output + stack[::-1]


def _unfinished(expression: str) -> bool:
    """Whether a parenthesis or an operator is open at the end of an expression, so that it goes on."""
    depth, operand_next = 0, True
    for token in _tokens(expression.lower()):
        if token in PRECEDENCE:
            if operand_next:
                return False
            operand_next = True
        elif token == "(":
            if not operand_next:
                return False
            depth += 1
        elif token == ")":
            depth -= 1
            if operand_next or depth < 0:
                return False
        elif not operand_next:
            return False  # prose behind the expression
        else:
            operand_next = False
    return depth > 0 or operand_next


def _expression(raw: bytes, begin: int, end: int) -> bytes:
    """The expression behind a tag: its line, and those that follow (without their comment signs) while a parenthesis or an operator is open."""
    out = raw[begin:end]
    while out.strip() and (line := _NEXT_LINE.match(raw, end)) and line[1].strip() and not _TAG_TEXT.search(line[1]) and _unfinished(out.decode("latin-1")):
        out += b"\n" + line[1].lstrip(b" \t-#*/;%")
        end = line.end()
    return out


def _operands(expression: str) -> list[str]:
    """Identifiers of a malformed expression, up to prose behind it."""
    out: list[str] = []
    behind = False
    for token in _tokens(expression):
        if token in PRECEDENCE or token in ("(", ")"):
            behind = behind and token == ")"
        elif behind:
            break
        else:
            out.append(token)
            behind = True
    return out


def evaluate(expression: str, permitted: frozenset[str] = PERMITTED) -> tuple[list[str], bool]:
    """Identifiers of an expression in order of appearance, and whether it can be met with permitted licences."""
    line = postfix(expression.lower())
    if line is None:
        return _operands(expression.lower()), False
    stack: list[bool] = []
    names: list[str] = []
    for token in line:
        if token not in PRECEDENCE:
            names.append(token)
            stack.append(token.rstrip("+") in permitted)
            continue
        right, left = stack.pop(), stack.pop()
        stack.append(left if token == "with" else left and right if token == "and" else left or right)
    return names, stack[0]


@functools.lru_cache(4)
def _automaton(base: tuple[tuple[str, str], ...]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for phrase in {*dict(base), *NOTICE_PHRASES, TAG}:
        automaton.add_word(f" {phrase} ", phrase)
    automaton.make_automaton()
    return automaton


#: Every byte that belongs to no word becomes a space; A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def scan(text: str | None, base: dict[str, str] = BASE_PHRASES, permitted: frozenset[str] = PERMITTED) -> dict:
    """What a text says of licences: places of base phrases, labels, expressions and a score."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_FOLD).split()
    joined = b" %s " % b" ".join(words) if words else b""
    found = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None}
    labels: set[str] = set()
    base_labels: set[str] = set()
    expressions: list[dict] = []
    doubt = 1.0
    noted: set[str] = set()
    at = word = 0
    # phrases end in order, so starts are told apart by counting spaces once over the text
    for end, phrase in _automaton(tuple(base.items())).iter(joined.decode("latin-1")):
        if phrase in base:
            word += joined.count(b" ", at, end + 1)
            at = end + 1
            start = word - len(phrase.split()) - 1
            found["n_base"] += 1
            found["first_word"] = start if found["first_word"] is None else min(start, found["first_word"])
            found["last_word"] = start if found["last_word"] is None else max(start, found["last_word"])
            base_labels.add(base[phrase])
            if phrase not in noted:
                doubt *= 1 - BASE_WEIGHT
        if phrase in NOTICE_PHRASES:
            label, weight = NOTICE_PHRASES[phrase]
            labels.add(label)
            if phrase not in noted:
                doubt *= 1 - weight
        noted.add(phrase)
    if TAG in noted:
        for m in _TAG_TEXT.finditer(raw.lower()):
            expression = _expression(m.string, *m.span("open")) if m["quoted"] is None else m["quoted"]
            names, allowed = evaluate(expression.decode("latin-1"), permitted)
            expressions.append({"expression": expression.decode("utf-8", "replace").strip(), "identifiers": names, "permitted": allowed})
            labels.update(f"spdx:{n}" for n in names)
            labels.add("spdx-permitted" if allowed else "spdx-restricted")
            doubt *= 0.01
    return found | {"base_labels": sorted(base_labels), "labels": sorted(labels | base_labels), "expressions": expressions, "score": 1 - doubt}


_SCHEMA = "struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:array<string>,labels:array<string>,expressions:array<struct<expression:string,identifiers:array<string>,permitted:boolean>>,score:double>"


def _scanner(base: dict[str, str], permitted: frozenset[str]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    words = pa.list_(pa.string())
    kind = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", words), ("labels", words), ("expressions", pa.list_(pa.struct([("expression", pa.string()), ("identifiers", words), ("permitted", pa.bool_())]))), ("score", pa.float64())])

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([scan(t.as_py(), base, permitted) for t in column], kind)

    return run


def license_scan(docs: DataFrame, text: str = "text", base: dict[str, str] | None = None, permitted: frozenset[str] = PERMITTED, into: str = "license") -> DataFrame:
    """docs with one more column, a struct of what scan() finds in the whole text. Other columns stay as they are."""
    scanner = F.arrow_udf(_scanner(base or BASE_PHRASES, permitted), _SCHEMA)
    return docs.withColumn(common.free_name(docs, into), scanner(docs[text]))
