"""Language ID by a linear-chain conditional random field over words.

Every word of a text gets a label. Its evidence is the sum of learned weights of its affixes (1 to 3 letters),
its letter n-grams (2 and 3) and its lexicon entries (how often the word stands in each language's sample);
learned transitions make labels cling together, so that a code-switched text is cut where the evidence turns.
Forward-backward gives each word's label distribution; a text's language is the one with most of that mass,
its score the share.

Fitting: a sample of at most SAMPLE_DOCS labelled rows of every language and at most SAMPLE_WORDS words of each (the
documented bound), on the driver. Every label that occurs is learnt; their number is taken to be that of languages. Half of the training chains are spliced from two languages, so that
transitions see switches. Only text and label are read.

Prediction: words are looked up in a bounded table of evidence, new ones are scored together. Chains are cut
into blocks; products of the blocks' step matrices carry the forward and backward messages over the cuts, so
that the result is that of the whole chain while numpy works on all blocks at once.

Defined results: null texts and texts without a letter are `und` with score 0; without labelled rows every text
is `und`; repeated rows get equal results, and count once in the sample; of labels of equal mass the first in code
point order is given; an empty table gives no rows; words are of any length (read in pieces of LETTERS letters), and
letters of scripts without spaces are words; other columns pass unchanged, and the new one's name gives way to theirs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm import common

#: The bound of the sample: rows a language, and words of a row (evenly spaced windows of a longer text).
SAMPLE_DOCS, SAMPLE_WORDS = 120, 1200
#: Buckets of hashed features, letters of a word (longer ones are read in pieces), and words remembered.
BUCKETS, LETTERS, REMEMBERED = 1 << 15, 24, 100_000
#: Words of a training chain and of an inference block.
CHAIN, BLOCK = 64, 32
UNDETERMINED = "und"
#: Scripts that are written without spaces; each of their letters is a word.
_SINGLE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W\d_{_SINGLE}]{{1,{LETTERS}}}|[{_SINGLE}]")


def _hash(codes: np.ndarray, salt: int) -> np.ndarray:
    """Bucket (1 and up) of each row's letters."""
    value = np.full(codes.shape[:-1], salt, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(codes.shape[-1]):
            value = value * np.uint64(0x100000001B3) ^ codes[..., i]
    return (common.mix(value) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1


def features(words: list[str]) -> np.ndarray:
    """Buckets of each word's affixes and n-grams; 0 where a word is too short for one."""
    text = np.array(words, f"U{LETTERS}")
    letters = text.view(np.uint32).reshape(len(words), LETTERS).astype(np.uint64)
    length = np.char.str_len(text)
    padded = np.zeros((len(words), LETTERS + 2), np.uint64)
    padded[:, 1:-1] = letters
    padded[:, 0] = 94
    padded[np.arange(len(words)), length + 1] = 36
    out = []
    for k in (1, 2, 3):
        out.append(np.where(length >= k, _hash(letters[:, :k], k), 0)[:, None])
        ends = np.maximum(length[:, None] - k + np.arange(k), 0)
        out.append(np.where(length >= k, _hash(np.take_along_axis(letters, ends, 1), 10 + k), 0)[:, None])
    for k in (2, 3):
        windows = np.lib.stride_tricks.sliding_window_view(padded, k, 1)
        out.append(np.where(np.arange(windows.shape[1]) + k <= length[:, None] + 2, _hash(windows, 20 + k), 0))
    return np.hstack(out)


class Chain:
    """The fitted field: labels, bucket weights, lexicon with its weights, transitions (as factors)."""

    def __init__(self, labels: list[str], weights: np.ndarray, lexicon: dict[str, np.ndarray], lexicon_weight: np.ndarray, transitions: np.ndarray):
        self.labels, self.weights, self.lexicon, self.lexicon_weight = labels, weights, lexicon, lexicon_weight
        self.factors = np.exp(transitions - transitions.max())

    def evidence(self, words: list[str]) -> np.ndarray:
        """Factors of each word and label, the largest of a word being 1."""
        out = np.empty((len(words), len(self.labels)))
        none = np.zeros(len(self.labels), np.float32)
        for at in range(0, len(words), 8192):
            some = words[at : at + 8192]
            score = self.weights[features(some)].sum(1, dtype=np.float64)
            score += np.array([self.lexicon.get(w, none) for w in some]) * self.lexicon_weight
            out[at : at + 8192] = np.exp(np.maximum(score - score.max(1, keepdims=True), -30.0))
        return out

    def label_words(self, evidence: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Label distribution of each word by forward-backward. evidence: the words of all texts in order; counts: words of each text."""
        n_labels, a = len(self.labels), self.factors
        parts = -(-counts // BLOCK)
        n = int(parts.sum())
        if not n:
            return np.zeros((0, n_labels))
        first = np.cumsum(parts) - parts
        owner = np.repeat(np.arange(len(counts)), parts)
        filled = np.minimum(BLOCK, counts[owner] - (np.arange(n) - first[owner]) * BLOCK)
        slot = np.arange(BLOCK) < filled[:, None]
        e = np.ones((n, BLOCK, n_labels))
        e[slot] = evidence
        product = np.broadcast_to(np.eye(n_labels), (n, n_labels, n_labels)).copy()
        for t in range(BLOCK):
            live = slot[:, t]
            step = (product[live].reshape(-1, n_labels) @ a).reshape(-1, n_labels, n_labels) * e[live, t][:, None, :]
            product[live] = step / step.max((1, 2), keepdims=True)
        into = np.full((n, n_labels), 1.0 / n_labels)
        behind = np.ones((n, n_labels))
        texts = np.argsort(-parts, kind="stable")
        ranked = parts[texts]
        for k in range(1, int(ranked[0])):
            live = texts[: np.searchsorted(-ranked, -k, "left")]  # texts with more than k blocks
            b = first[live] + k
            message = np.einsum("ni,nij->nj", into[b - 1], product[b - 1])
            into[b] = message / message.sum(1, keepdims=True)
            b = first[live] + parts[live] - k
            message = np.einsum("nij,nj->ni", product[b], behind[b])
            behind[b - 1] = message / message.max(1, keepdims=True)
        forward = np.empty_like(e)
        for t in range(BLOCK):
            into = into @ a * e[:, t]
            into /= into.sum(1, keepdims=True)
            forward[:, t] = into
        for t in range(BLOCK - 1, -1, -1):
            behind_here = behind
            forward[:, t] *= behind_here
            step = (e[:, t] * behind) @ a.T
            step /= step.max(1, keepdims=True)
            behind = np.where(slot[:, t][:, None], step, behind)
        out = forward[slot]
        return out / out.sum(1, keepdims=True)


def sample(text: str) -> list[str]:
    """The words of a text that the fit sees: all, or those of evenly spaced windows of a longer text."""
    words = [w for w in _WORD.findall(text.lower()) if any(c.isalpha() for c in w)]
    if len(words) > SAMPLE_WORDS:
        starts = np.linspace(0, len(words) - CHAIN, SAMPLE_WORDS // CHAIN).astype(int)
        words = [w for s in starts for w in words[s : s + CHAIN]]
    return words


def _sampled(texts: pa.Array) -> pa.Array:
    """The sample of each text as text."""
    return pa.array([" ".join(sample(t.as_py())) for t in texts], pa.string())


def fit(rows: list[tuple[str, str]], seed: int = 7, epochs: int = 5) -> Chain | None:
    """Fit a chain to (text, label) rows by gradient ascent on the conditional likelihood."""
    rng = np.random.default_rng(seed)
    labels = sorted({label for _, label in rows})
    by_label: dict[int, list[str]] = {k: [] for k in range(len(labels))}
    for text, label in rows:
        by_label[labels.index(label)] += sample(text)
    labels_with = [k for k, v in by_label.items() if v]
    if not labels_with:
        return None
    n = len(labels)
    counts: dict[str, np.ndarray] = {}
    for k, words in by_label.items():
        for w in words:
            counts.setdefault(w, np.zeros(n))[k] += 1
    totals = np.array([max(1, len(by_label[k])) for k in range(n)], float)
    lexicon = {}
    for w, c in counts.items():
        if c.sum() >= 3:
            rate = (c + 0.1) / totals
            lexicon[w] = np.log(rate / rate.sum() * n).clip(-3, 3).astype(np.float32)
    vocabulary = sorted(counts)
    index = {w: i for i, w in enumerate(vocabulary)}
    buckets = features(vocabulary)
    known = np.array([lexicon.get(w, np.zeros(n, np.float32)) for w in vocabulary])
    streams = {k: np.array([index[w] for w in by_label[k]]) for k in labels_with}
    half = CHAIN // 2
    halves = [(k, s[i : i + half]) for k, s in streams.items() for i in range(0, max(1, len(s) - half + 1), half) if len(s) >= half]
    halves += [(k, np.resize(s, half)) for k, s in streams.items() if len(s) < half]
    weights, lexicon_weight, transitions = np.zeros((BUCKETS, n)), np.ones(n) * 0.3, np.eye(n)
    grown = [np.full_like(x, 1e-2) for x in (weights, lexicon_weight, transitions)]
    pure = {k: [i for i, (x, _) in enumerate(halves) if x == k] for k in labels_with}
    for _ in range(epochs):
        order = rng.permutation(len(halves))
        second = np.array([order[(j + 1) % len(order)] if rng.random() < 0.5 else rng.choice(pure[halves[i][0]]) for j, i in enumerate(order)])
        for at in range(0, len(order), 64):
            pairs = list(zip(order[at : at + 64], second[at : at + 64], strict=True))
            words = np.array([np.concatenate([halves[i][1], halves[j][1]]) for i, j in pairs])
            truth = np.array([[halves[i][0]] * half + [halves[j][0]] * half for i, j in pairs])
            score = weights[buckets[words]].sum(2) + known[words] * lexicon_weight
            e = np.exp(np.maximum(score - score.max(2, keepdims=True), -30))
            gamma, pairs_expected = _expectations(e, np.exp(transitions - transitions.max()))
            residual = np.eye(n)[truth] - gamma
            gradient = np.empty_like(weights)
            ids = buckets[words].reshape(-1)
            width = buckets.shape[1]
            for k in range(n):
                gradient[:, k] = np.bincount(ids, np.repeat(residual[..., k].reshape(-1), width), BUCKETS)
            gradient[0] = 0
            seen = np.zeros((n, n))
            np.add.at(seen, (truth[:, :-1].reshape(-1), truth[:, 1:].reshape(-1)), 1)
            steps = (gradient - 1e-3 * weights, (residual * known[words]).sum((0, 1)), seen - pairs_expected - 0.1 * transitions)
            for x, g, total, rate in zip((weights, lexicon_weight, transitions), steps, grown, (0.1, 0.02, 0.05), strict=True):
                total += g * g
                x += rate * g / np.sqrt(total)
    return Chain(labels, weights.astype(np.float32), lexicon, lexicon_weight, transitions)


def _expectations(e: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label distributions and expected transitions of chains of one length."""
    m, length, n = e.shape
    forward, backward = np.empty_like(e), np.ones_like(e)
    alpha = np.full((m, n), 1.0 / n)
    for t in range(length):
        alpha = alpha @ a * e[:, t]
        alpha /= alpha.sum(1, keepdims=True)
        forward[:, t] = alpha
    for t in range(length - 2, -1, -1):
        beta = (e[:, t + 1] * backward[:, t + 1]) @ a.T
        backward[:, t] = beta / beta.max(1, keepdims=True)
    gamma = forward * backward
    gamma /= gamma.sum(2, keepdims=True)
    ahead = e[:, 1:] * backward[:, 1:]
    norm = np.einsum("mti,ij,mtj->mt", forward[:, :-1], a, ahead)
    return gamma, a * np.einsum("mti,mtj->ij", forward[:, :-1] / norm[..., None], ahead)


def learn(docs: DataFrame, rows: Column, text: str = "text", label: str = "lang", doc_id: str = "doc_id") -> Chain | None:
    """Fit a chain to a bounded sample of the labelled rows that `rows` admits: per label, those of the smallest hash of doc_id."""
    labelled = docs.where(rows & docs[label].isNotNull() & docs[text].isNotNull()).select(docs[text].alias("text"), docs[label].cast("string").alias("label"), F.xxhash64(docs[doc_id], docs[text]).alias("draw"))
    counted = labelled.groupBy("label").count().collect()  # a row a language
    if not counted:
        return None
    # a little over the wanted rows of each label are drawn by the hash, then cut to the bound; equal rows are drawn once
    edges = [(r["label"], min((int(min(1.0, 1.5 * (SAMPLE_DOCS + 20) / r["count"]) * (1 << 32)) << 32) - (1 << 63), (1 << 63) - 1)) for r in counted]
    edges = F.broadcast(common.small_table(docs.sparkSession, edges, "label string, edge long"))
    drawn = labelled.join(edges, "label").where("draw <= edge").dropDuplicates(["label", "draw"])
    drawn = drawn.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("draw", "text"))).where(F.col("place") <= SAMPLE_DOCS)
    # windows of a long text are taken in the executors
    taken = drawn.select("label", "draw", F.arrow_udf(_sampled, "string")("text").alias("text")).collect()
    return fit([(r["text"], r["label"]) for r in sorted(taken, key=lambda r: (r["label"], r["draw"], r["text"]))])


class _Table(dict):
    """Numbers of words in order of first sight."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


_tables: dict[int, list] = {}


def _predictor(broadcast, with_words: bool) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())] + ([("words", pa.list_(pa.string()))] if with_words else []))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        chain: Chain | None = broadcast.value
        for column in common.tidy(columns):
            results: list[dict] = []
            for piece in common.slices([pa.record_batch([column], ["text"])], "text"):
                results += predict(chain, piece.column(0).to_pylist(), with_words)
            yield pa.array(results, kind)

    return run


def predict(chain: Chain | None, texts: list[str | None], with_words: bool = False) -> list[dict]:
    if chain is None:
        return [{"lang": UNDETERMINED, "score": 0.0, "words": []} for _ in texts]
    state = _tables.get(id(chain))
    if state is None or len(state[0]) > REMEMBERED:
        _tables.clear()
        state = _tables[id(chain)] = [_Table(), np.zeros((0, len(chain.labels))), np.zeros(0, bool), chain]
    table = state[0]
    numbers: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    look = table.__getitem__
    for i, text in enumerate(texts):
        if text:
            before = len(numbers)
            numbers.extend(map(look, _WORD.findall(text.lower())))
            counts[i] = len(numbers) - before
    if table.new:
        state[1] = np.vstack([state[1], chain.evidence(table.new)])
        state[2] = np.append(state[2], [any(c.isalpha() for c in w) for w in table.new])
        table.new.clear()
    words = np.array(numbers, np.int64)
    lettered = state[2][words]
    if not lettered.all():
        owner = np.repeat(np.arange(len(texts)), counts)
        words, counts = words[lettered], np.bincount(owner[lettered], minlength=len(texts))
    labelled = chain.label_words(state[1][words], counts)
    some = np.flatnonzero(counts)
    mass = np.zeros((len(texts), len(chain.labels)))
    if len(some):
        mass[some] = np.add.reduceat(labelled, (np.cumsum(counts) - counts)[some]) / counts[some][:, None]
    best = mass.argmax(1)
    ends = np.cumsum(counts)
    return [
        {"lang": chain.labels[best[i]] if counts[i] else UNDETERMINED, "score": float(min(1.0, mass[i, best[i]])) if counts[i] else 0.0}
        | ({"words": [chain.labels[k] for k in labelled[ends[i] - counts[i] : ends[i]].argmax(1)]} if with_words else {})
        for i in range(len(texts))
    ]


def identify(docs: DataFrame, chain: Chain | None, text: str = "text", with_words: bool = False, into: str = "language") -> DataFrame:
    """docs with one more column: a struct of lang and score (and words, the label of each word with a letter)."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    predictor = F.arrow_udf(_predictor(sent, with_words), "struct<lang:string,score:double" + (",words:array<string>" if with_words else "") + ">")
    return docs.withColumn(common.free_name(docs, into), predictor(docs[text]))


def held_in(doc_id: Column) -> Column:
    """Rows that may be learnt from: crc32 of doc_id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(True))
