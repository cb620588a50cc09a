import random
from collections import defaultdict

import numpy as np
import pytest

from readloom.llm import packing
from readloom.llm.queries import tokenizer_file

from .conftest import sentence

PATH = tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_are_the_tokenizers(reference, awkward):
    rng = random.Random(1)
    encode = packing.encoder(PATH)
    texts = ["".join(rng.choice("ab  xyZ\n\t東é😀'st 12<|endoftext|>") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "<|endoftext", "<|endoftext|>" + " " * 6000]
    for t in [*texts, *(t for _, t in awkward if t), " " * 20_000 + "x"]:
        assert encode(t).tolist() == reference.encode(t, add_special_tokens=False).ids


def test_cuts():
    for n in range(1, 3000):
        pieces = packing.cuts(n)
        assert sum(pieces) == n and all(0 < p <= 1024 for p in pieces) and len(pieces) - n // 1024 <= 8
        for p in pieces:
            assert 1024 // p * p >= 1024 * (1 - packing.SLACK) - 1024 // p


def test_classes_are_filled_by_count():
    packer = packing.Packer()
    placed = [x for i in range(1000) for x in packer.add(i, 341)]
    by_sequence = defaultdict(list)
    for d, _, n, s, o in placed:
        by_sequence[s].append((o, n, d))
    assert all(len(v) == 3 for v in by_sequence.values()) and len(by_sequence) == 333
    rest = packer.finish()
    assert len(rest) == 1 and packer.finish() == []


def check(rows, expected):
    """Every id once, in gapless sequences of at most the capacity."""
    documents, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0
        documents[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
    for i, texts in expected.items():
        pieces = documents.pop(i)
        assert sum(len(p[1]) for p in pieces) == sum(len(t) for t in texts)
        if len(texts) == 1:
            assert np.concatenate([p[1] for p in sorted(pieces, key=lambda p: p[0])]).tolist() == texts[0]
            assert {p[2] for p in pieces} == {len(texts[0])}
    assert not documents
    return sequences


def test_operator(frame, awkward, reference):
    rng = random.Random(2)
    rows = [*awkward, *((100 + i, sentence(rng, rng.randint(1, 900))) for i in range(80))]
    expected = defaultdict(list)
    for i, t in rows:
        expected[i].append([*reference.encode(t or "", add_special_tokens=False).ids, 0])
    out = packing.pack(frame(rows).coalesce(2), PATH).collect()
    sequences = check(out, expected)
    tokens = sum(len(t) for v in expected.values() for t in v)
    assert tokens / 1024 / len(sequences) > 0.97
    again = packing.pack(frame(rows).coalesce(2), PATH).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)
    assert packing.pack(frame([]), PATH).count() == 0
