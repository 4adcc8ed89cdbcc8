"""Quality by compression: does a text compress better with a dictionary of good or of bad text?

Pairs of zstandard dictionaries, one of good and one of bad text each, are built from labelled text. A text's score is a
calibrated, rising function of one number: the difference of its compressed sizes, averaged over the pairs and normalised by
its length. Texts of equal difference have equal scores.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervane.llm.common import bounded_sample, docs_of, from_rows, release, slices

THRESHOLD = 0.3
_TILT = 0.01
SCORES = "doc_id long, score double, predicted int, good_bytes double, bad_bytes double, difference double"
_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("good_bytes", pa.float64()), ("bad_bytes", pa.float64()), ("difference", pa.float64())])


@dataclass(frozen=True)
class Model:
    """Dictionary pairs (good, bad), their compression level, and the score: rates of good text at rising differences, straight in between.

    Beyond the outermost differences the score goes on by a small part of a logistic curve, so that it rises everywhere.
    """

    pairs: tuple[tuple[bytes, bytes], ...]
    level: int
    differences: tuple[float, ...]
    rates: tuple[float, ...]

    def scorer(self):
        """text -> (score, mean size with the good dictionaries, with the bad ones, normalised difference)."""
        pairs = _compressors(self.pairs, self.level)

        def run(text: str) -> tuple[float, float, float, float]:
            t = text.encode("utf-8", "surrogatepass")
            good, bad = _sizes(pairs, t)
            d = difference(good, bad, len(t))
            return self.of(d), good, bad, d

        return run

    def of(self, d: float) -> float:
        """Score of a normalised difference."""
        tilt = _TILT if len(self.rates) > 1 else 0.0
        return (1 - tilt) * float(np.interp(d, self.differences, self.rates)) + tilt / (1 + math.exp(-max(-30.0, min(30.0, d))))


def difference(good: float, bad: float, n: int) -> float:
    """Bytes saved by the good dictionary, over the square root of the length: what texts of one kind save varies about so much."""
    return (bad - good) / math.sqrt(n + 20)


def _compressors(pairs, level: int) -> list[tuple]:
    return [(_compressor(g, level), _compressor(b, level)) for g, b in pairs]


def _sizes(pairs: list[tuple], t: bytes) -> tuple[float, float]:
    return sum(len(g(t)) for g, _ in pairs) / len(pairs), sum(len(b(t)) for _, b in pairs) / len(pairs)


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the texts' own bytes where there is too little to train on."""
    total = sum(map(len, texts))
    if len(texts) >= 20 and total >= 8 * size:
        try:
            return zstandard.train_dictionary(size, texts).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"\n".join(texts)[-size:]


def _compressor(dictionary: bytes, level: int):
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(level=level, write_content_size=False).compress
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False).compress


def fit(rows: list[tuple[int, str, int]], prior: float | None = None, size: int = 32_768, level: int = 3, folds: int = 3) -> Model:
    """A dictionary pair from all labelled rows but one fold, for each fold; calibration on differences that each fold has with its own pair.

    prior: share of good documents among all labelled ones. With fewer than five documents of a class every score is that share.
    """
    texts = [t.encode("utf-8", "surrogatepass") for _, t, _ in rows]
    y = np.array([r[2] for r in rows], dtype=float)
    share = float(np.clip(prior if prior is not None else (y.mean() if len(y) else 0.5), 1e-4, 1 - 1e-4))
    fold = np.arange(len(rows)) % folds
    pairs = tuple(tuple(_dictionary([t for t, label, f in zip(texts, y, fold) if label == k and f != own], size) for k in (1, 0)) for own in range(folds))
    if min((y == 1).sum(), (y == 0).sum()) < 5:
        return Model(pairs, level, (0.0,), (share,))
    ready = _compressors(pairs, level)
    d = np.array([difference(*_sizes([ready[f]], t), len(t)) for t, f in zip(texts, fold.tolist())])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(pairs, level, *_rising(d, y, weight))


def _rising(d: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Isotonic regression of y over d, by pooling neighbours that fall: (mean difference, rate) of each pool, rates kept off 0 and 1."""
    pools: list[list[float]] = []  # weight, weight of y, weighted sum of d
    for k in np.argsort(d, kind="stable").tolist():
        pools.append([weight[k], weight[k] * y[k], weight[k] * d[k]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    least = 0.5 / (weight.sum() + 1)
    return tuple(float(s / w) for w, _, s in pools), tuple(float(np.clip(g / w, least, 1 - least)) for w, g, _ in pools)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = 3000, max_chars: int = 12_000_000) -> Model:
    """Fit on at most per_class documents and max_chars characters of each class. labels: doc_id and label_col, of the rows to learn from."""
    use = labels.select("doc_id", F.col(label_col).alias("label"))
    prior = use.where("label is not null").agg(F.avg(F.col("label").cast("double"))).first()[0]
    model = fit(bounded_sample(docs_of(docs), use, per_class, max_chars), prior)
    release()
    return model


def learnable(labels: DataFrame) -> DataFrame:
    """Rows to learn from: crc32 of doc_id as text, modulo 5, is not 0."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, good_bytes, bad_bytes, difference) for every row of docs: sizes are means over the dictionary pairs.

    A null is an empty text, and an empty text gets what its empty frames' sizes give. Repeated rows are scored alike.
    """

    def run(batches):
        of = model.scorer()
        for batch in batches:
            for part in slices(batch):
                rows = []
                for name, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    p, g, b, d = of(text)
                    rows.append((name, p, int(p >= THRESHOLD), g, b, d))
                yield from_rows(rows, _SCORES)

    return docs_of(docs).mapInArrow(run, SCORES)
