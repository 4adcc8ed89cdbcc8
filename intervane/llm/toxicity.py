"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

p(document) = 1 - prod over sentences (1 - sigmoid(bias + sum of word weights)): noisy-or. The weights are learned from
document labels alone, on a bounded sample of labelled rows; the same sentence scores then locate the offending sentences.
"""

from __future__ import annotations

import math
import re
from array import array
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervane.llm.common import bounded_sample, docs_of, from_rows, release, releasing_task, slices

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_STEMS = (4, 5, 6)
_KEPT_WORDS = 300_000
THRESHOLD = 0.3
SCORES = "doc_id long, score double, predicted int, n_sentences long, sentences array<struct<start:long,stop:long,score:double>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))
_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_sentences", pa.int64()), ("sentences", _SPAN)])


def features(word: str) -> list[str]:
    """A word itself, and its first letters, which its inflected forms share."""
    return ["=" + word, *(word[:k] for k in _STEMS if len(word) >= k)]


class _Words(dict):
    """Weight of each word met, kept until there are too many."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > _KEPT_WORDS:
            self.clear()
        get = self.weights.get
        self[word] = out = sum(get(f, 0.0) for f in features(word))
        return out


@dataclass(frozen=True)
class MilModel:
    """weights: by feature of a word; see features()."""

    weights: dict[str, float]
    bias: float

    @cached_property
    def words(self) -> _Words:
        return _Words(self.weights)

    def sentences(self, text: str):
        """(start, stop, logit) of each sentence that holds a weighted word, and the number of all sentences."""
        found, n, weight = [], 0, self.words.__getitem__
        low = text.lower()
        if len(low) != len(text):  # lower case can change lengths; spans must be of the text itself
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        for m in _SENTENCE.finditer(low):
            n += 1
            s = sum(map(weight, _WORD.findall(m[0])))
            if s:
                found.append((m.start(), m.end(), self.bias + s))
        return found, n

    def score(self, text: str) -> tuple[float, int, list[tuple[int, int, float]]]:
        """Noisy-or score, number of sentences, and the sentences of probability 1/2 or more. A text without sentences scores as one empty sentence."""
        found, n = self.sentences(text)
        off = _softplus(self.bias) * (max(n, 1) - len(found)) + sum(_softplus(s) for _, _, s in found)
        return -math.expm1(-off), n, [(a, b, 1 / (1 + math.exp(-s))) for a, b, s in found if s >= 0]


def _softplus(x: float) -> float:
    return max(x, 0.0) + math.log1p(math.exp(-abs(x)))


def fit(rows: list[tuple[int, str, int]], prior: float | None = None, min_docs: int = 4, evidence: float = 20.0, steps: int = 300, ridge: float = 2e-3) -> MilModel:
    """Learn sentence weights from (doc_id, text, label) rows.

    prior: share of toxic documents among all labelled ones; the classes of the sample are weighted to it.
    With one class only, no weights are learned and the bias gives that class's share.
    """
    y = np.array([r[2] for r in rows], dtype=float)
    share = float(np.clip(prior if prior is not None else (y.mean() if len(y) else 0.1), 1e-4, 1 - 1e-4))
    if not len(y) or y.min() == y.max():
        return MilModel({}, math.log(share / (1 - share)))
    # Words as numbers, end to end, from here on: strings of a sample of many megabytes would be most of the driver's memory.
    number: dict[str, int] = {}
    flat, lengths, sentences = array("i"), array("i"), array("i")
    for _, t, _ in rows:
        found = _SENTENCE.findall(t.lower()) or [""]
        sentences.append(len(found))
        for s in found:
            before = len(flat)
            flat.extend(number.setdefault(w, len(number)) for w in _WORD.findall(s))
            lengths.append(len(flat) - before)
    names = list(number)
    words, lengths, sent_doc = np.array(flat), np.array(lengths), np.repeat(np.arange(len(rows)), np.array(sentences))
    word_sent = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.searchsorted(sent_doc[word_sent], np.arange(len(rows)), side="right")
    seen: dict[str, list[int]] = {}
    for begin, end, label in zip(np.concatenate([[0], ends]), ends, y):
        for f in {f for w in np.unique(words[begin:end]) for f in features(names[w])}:
            seen.setdefault(f, [0, 0])[int(label)] += 1
    n1, n0 = y.sum(), len(y) - y.sum()
    # Features of toxic documents by more than chance (a likelihood ratio); the rest would only be fitted noise.
    vocab: dict[str, int] = {}
    for f, (a0, a1) in sorted(seen.items()):
        if a0 + a1 >= min_docs and a1 / n1 > a0 / n0:
            e1 = (a0 + a1) * n1 / (n0 + n1)
            if 2 * (a1 * math.log(a1 / e1) + (a0 * math.log(a0 / (a0 + a1 - e1)) if a0 else 0)) > evidence:
                vocab[f] = len(vocab)
    of_word = [[vocab[f] for f in features(w) if f in vocab] for w in names]
    many = np.array([len(x) for x in of_word], dtype=np.int64)
    csr, first = np.array([f for x in of_word for f in x], dtype=np.int64), np.cumsum(many) - many
    hit = many[words] > 0
    words, tok_sent = words[hit], word_sent[hit]
    times = many[words]
    tok_sent = np.repeat(tok_sent, times)
    tok = csr[np.repeat(first[words] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
    del flat, number, seen, of_word, word_sent
    weight = np.where(y == 1, share * len(y) / n1, (1 - share) * len(y) / n0) / len(y)
    x = np.concatenate([np.zeros(len(vocab)), [-6.0]])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        s = x[-1] + np.bincount(tok_sent, x[tok], minlength=len(sent_doc)) if len(tok) else np.full(len(sent_doc), x[-1])
        on = 1 / (1 + np.exp(-s))
        off = np.bincount(sent_doc, np.logaddexp(0, s), minlength=len(y))
        rate = np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(off, 50)), 1e-9), 1.0) * weight
        g_s = rate[sent_doc] * on
        g = np.concatenate([np.bincount(tok, g_s[tok_sent], minlength=len(vocab)) if len(tok) else np.zeros(len(vocab)), [g_s.sum()]])
        g[:-1] += ridge / len(vocab) * x[:-1] if len(vocab) else 0
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-12) * min(1.0, 2 * (1 - step / (steps + 1)))
    return MilModel({w: round(float(x[k]), 6) for w, k in vocab.items() if abs(x[k]) >= 0.05}, round(float(x[-1]), 6))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = 3000, max_chars: int = 12_000_000) -> MilModel:
    """Fit on at most per_class documents and max_chars characters of each class. labels: doc_id and label_col, of the rows to learn from."""
    use = labels.select("doc_id", F.col(label_col).alias("label"))
    prior = use.where("label is not null").agg(F.avg(F.col("label").cast("double"))).first()[0]
    model = fit(bounded_sample(docs_of(docs), use, per_class, max_chars), prior)
    release()
    return model


def score(docs: DataFrame, model: MilModel) -> DataFrame:
    """(doc_id, score, predicted, n_sentences, sentences) for every row of docs; sentences: spans (code points) and scores of the offending ones."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = []
                for name, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    p, n, spans = model.score(text)
                    rows.append((name, p, int(p >= THRESHOLD), n, [{"start": a, "stop": b, "score": s} for a, b, s in spans]))
                yield from_rows(rows, _SCORES)

    return docs_of(docs).mapInArrow(run, SCORES)


def learnable(labels: DataFrame) -> DataFrame:
    """Rows to learn from: crc32 of doc_id as text, modulo 4, is not 2."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)


def keep_clean(docs: DataFrame, model: MilModel) -> DataFrame:
    """Rows of docs (all columns as they are) that the model doesn't predict toxic."""
    row_schema = docs.schema
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                keep = [model.score(t or "")[0] < THRESHOLD for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(releasing_task(run), row_schema)
