import random

import pytest
from tokenizers import Tokenizer, models, normalizers

from readloom.llm import token_counts
from readloom.llm.queries import tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")


def reference(vocabulary, fallback):
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=fallback))
    tokenizer.normalizer = normalizers.Sequence([normalizers.Prepend(token_counts.MARK), normalizers.Replace(" ", token_counts.MARK)])
    return tokenizer


def texts(seed, n=800):
    rng = random.Random(seed)
    return ["".join(rng.choice("aabt he  \n\t東é😀<s></s>▁0xing") for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_counts_are_the_tokenizers(awkward):
    vocabulary = token_counts.pieces(PATH)
    model, other = token_counts.Unigram(vocabulary), reference(vocabulary, True)
    assert model.by_word
    for t in [*texts(1), *(t for _, t in awkward if t and len(t) < 30_000)]:
        assert model.count(t)[0] == len(other.encode(t, add_special_tokens=False).ids), t


@pytest.mark.parametrize("fallback", [False, True])
def test_ties_and_small_vocabularies(fallback):
    """Few pieces of few scores tie often; some span words, some letters are missing."""
    rng = random.Random(2)
    for _ in range(25):
        pieces = {"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(10)}
        vocabulary = [("<unk>", 0.0), *((f"<0x{i:02X}>", -9.0) for i in range(256)), *((p, float(-rng.randint(1, 3))) for p in sorted(pieces))]
        model, other = token_counts.Unigram(vocabulary, fallback), reference(vocabulary, fallback)
        for t in ["".join(rng.choice("aab bcé") for _ in range(rng.randint(1, 12))) for _ in range(60)]:
            assert model.count(t)[0] == len(other.encode(t, add_special_tokens=False).ids), (t, vocabulary[-10:])


def test_operator(frame, awkward):
    df = frame(awkward)
    out = token_counts.token_counts(df, PATH)
    assert out.columns == [*df.columns, "tokens_"]
    model = token_counts.load(PATH, True)
    got = sorted((r["doc_id"] or -1, r["tokens_"]["n_tokens"] if r["tokens_"] else -1) for r in out.collect())
    assert got == sorted((i or -1, -1 if t is None else model.count(t)[0]) for i, t in awkward)
    assert token_counts.token_counts(frame([]), PATH).count() == 0
