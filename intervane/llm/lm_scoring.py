"""Stupid-backoff scores of documents against counts of the whole corpus.

The tables of the relational plan are: exploded n-grams of documents; counts by n-gram, partitioned by its hash; and their
join, summed for each document. Rows of these tables travel in blocks (see ``exchange``): a block holds the sorted hashed
n-grams that a chunk of documents has in one hash bucket, each once, with its count there. A bucket adds up the blocks and
answers each with the totals in the same order, so that the join brings back one number for an n-gram and chunk, and a frequent
n-gram costs no more than one entry a chunk. Shuffles grow in proportion to the text, times the levels of the exchange.

Scores leave out the document itself: its own counts are taken off first, else every n-gram would be found at full length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervane.llm.common import docs_of, releasing, releasing_pair
from intervane.llm.exchange import BLOCKS, MOST, Fan, answered, deal, key_blocks, marks_of, small, texts, unfront, unsmall

_U = np.uint64
#: An odd base, and the multipliers of the splitmix64 finaliser.
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_LETTERS = np.random.Generator(np.random.PCG64(20240101)).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_LETTERS[65:91] = _LETTERS[97:123]  # A-Z are a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PIECE = 1 << 18
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = 1 << max(n, 1 << 16).bit_length()
        _powers[:] = [np.cumprod(np.concatenate([[_U(1)], np.full(size, _U(b % (1 << 64)))]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each text): words lie between ASCII white space, A-Z are lowered."""
    hashes, counts = [], np.zeros(len(texts), dtype=np.int64)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < _PIECE):
            size += len(texts[end]) + 1
            end += 1
        raw = np.frombuffer(b" ".join(texts[at:end]) + b" ", dtype=np.uint8)
        space = _SPACE[raw]
        edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
        start, stop = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
        power, inverse = _power(len(raw) + 1)
        total = np.concatenate([[_U(0)], np.cumsum(_LETTERS[raw] * power[: len(raw)], dtype=np.uint64)])
        hashes.append(_mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64)))
        bounds = np.cumsum([len(t) + 1 for t in texts[at:end]])
        counts[at:end] = np.diff(np.concatenate([[0], np.searchsorted(start, bounds)]))
        at = end
    return (np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)), counts


def _grams(texts: list[bytes], order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """(keys, positions of their last words) for each n, document of each word, words of each document."""
    h, counts = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    keys, ends, last = [], [], h
    for n in range(1, order + 1):
        if n > 1:
            last = np.concatenate([[_U(0)], last[:-1]]) if len(last) else last
            last = _mix(last * _U(0xD6E8FEB86659FD93) + h + _U(n))
        ok = np.nonzero(place >= n - 1)[0]
        keys.append(last[ok])
        ends.append(ok)
    return keys, ends, doc, counts


_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("log10_score", pa.float64()), ("mean_log10", pa.float64()), ("hits", pa.list_(pa.int64()))])


class _Counts:
    """Blocks of n-gram keys and counts: combined entries add up."""

    def combine(self, table: pa.Table, cuts: np.ndarray | None) -> tuple:
        sizes = table["n"].to_pylist()
        keys = np.concatenate([unfront(x) for x in table["keys"].to_pylist()])
        counts = np.concatenate([unsmall(x, n) for x, n in zip(table["extra"].to_pylist(), sizes)])
        keys, where = np.unique(keys, return_inverse=True)
        return keys, np.bincount(where, counts).astype(np.int64), where, np.cumsum(sizes)

    def send(self, state: tuple, sender: int, first_bucket: int, cuts: np.ndarray) -> pa.Table:
        return key_blocks(sender, first_bucket, state[0], state[1], cuts)

    def settle(self, state: tuple) -> np.ndarray:
        return state[1]

    def read(self, marks: list[tuple[int, bytes]]) -> np.ndarray:
        return np.concatenate([unsmall(m, n) for n, m in marks]) if marks else np.zeros(0, np.int64)

    def give(self, state: tuple, answers: np.ndarray) -> list[bytes]:
        if len(answers) != len(state[0]):
            raise RuntimeError("the answers do not fit the blocks")
        return [small(x) for x in np.split(answers[state[2]], state[3][:-1])]


def score(docs: DataFrame, order: int = 3, alpha: float = 0.4, chunk_bytes: int = 6 << 20, most: int = MOST) -> DataFrame:
    """(doc_id, n_tokens, log10_score, mean_log10, hits) for every row of docs.

    log10_score: sum over words of log10 S, S = c(n-gram) / c(its first n-1 words) for the longest n-gram that occurs outside
    the document, times alpha for each step down from order; for one word c(word) / N; for a word found nowhere else alpha
    once more times 1 / N. Counts and N are those of all other rows of docs. hits: words scored with n = order, ..., 1, and
    not found. A null, an empty text or one of white space has score 0, no words and no mean; if no other row has words, N
    counts as 1. Rows are scored each on its own: rows without doc_id, and repeated rows, count as documents that others see.
    n-grams are held as 64-bit hashes: of 10**13 distinct ones about one in two million shares its key and so its count.
    chunk_bytes: text worked on at a time by a task; a longer document is a chunk of its own. most: ways a chunk splits its keys.
    """
    d = docs_of(docs)
    sizes = d.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("words")).first()
    n_all = sizes.words or 0
    fan = Fan.of(d, sizes.bytes or 0, chunk_bytes, most)
    d = deal(d, fan)

    def blocks(table: pa.Table) -> pa.Table:
        keys, counts = np.unique(np.concatenate(_grams(texts(table), order)[0]), return_counts=True)
        return key_blocks(table["chunk"][0].as_py(), 0, keys, counts, fan.cuts(0))

    def score_chunk(table: pa.Table, answers: pa.Table) -> pa.Table:
        return _score(table, answers, order, alpha, n_all)

    totals = answered(d.groupBy("chunk").applyInArrow(releasing(blocks), BLOCKS), fan, _Counts()).repartition(fan.partitions, "sender")
    scores = "doc_id long, n_tokens long, log10_score double, mean_log10 double, hits array<long>"
    return d.groupBy("chunk").cogroup(totals.groupBy("sender")).applyInArrow(releasing_pair(score_chunk), scores)


def _score(table: pa.Table, answers: pa.Table, order: int, alpha: float, n_all: int) -> pa.Table:
    if table.num_rows == 0:
        return _SCORES.empty_table()
    keys, ends, doc, counts = _grams(texts(table), order)
    n_words, n_docs = len(doc), len(counts)
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = _Counts().read(marks_of(answers))
    if len(total) != len(distinct):
        raise RuntimeError("the answers do not fit the chunk")
    # Each n-gram's count outside its document.
    owner = np.concatenate([doc[e] for e in ends]) if n_words else np.zeros(0, np.int64)
    _, pair, own = np.unique(owner * max(len(distinct), 1) + where, return_inverse=True, return_counts=True)
    outside = total[where] - own[pair]
    found, at = [], 0
    for k, e in zip(keys, ends):
        c = np.zeros(n_words, np.int64)
        c[e] = outside[at : at + len(k)]
        found.append(c)
        at += len(k)
    log, level = np.zeros(n_words), np.full(n_words, -1)
    n_out = np.maximum(n_all - counts, 1)[doc]
    for n in range(order, 0, -1):
        open_ = (level < 0) & (found[n - 1] > 0)
        below = np.concatenate([[1], found[n - 2][:-1]]) if n > 1 and n_words else n_out
        log[open_] = np.log10(found[n - 1][open_] / below[open_]) + (order - n) * math.log10(alpha)
        level[open_] = n
    lost = level < 0
    log[lost] = -np.log10(n_out[lost]) + order * math.log10(alpha)
    level[lost] = 0
    sums = np.bincount(doc, log, minlength=n_docs)
    hits = np.bincount(doc * (order + 1) + order - level, minlength=n_docs * (order + 1)).reshape(n_docs, order + 1)
    mean = [float(s / n) if n else None for s, n in zip(sums, counts)]
    return pa.table([table["doc_id"], pa.array(counts), pa.array(sums), pa.array(mean, pa.float64()), pa.array(hits.tolist(), pa.list_(pa.int64()))], schema=_SCORES)


def sql(docs: str = "documents", alpha: float = 0.4) -> str:
    """Order 3 in DuckDB SQL: a list of WITH clauses that ends in lm_scores (doc_id, n_tokens, log10_score, mean_log10, n3, n2, n1, n0). doc_id must be unique."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    a = repr(alpha)
    return f"""
lm_words AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {docs})),
lm_grams AS (SELECT doc_id, i, w AS w3, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS w2, lag(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS w1 FROM lm_words),
lm_n AS (SELECT count(*) AS n FROM lm_words),
lm_docs AS (SELECT doc_id, count(*) AS n FROM lm_words GROUP BY doc_id),
c1 AS (SELECT w3, count(*) AS c FROM lm_grams GROUP BY ALL), o1 AS (SELECT doc_id, w3, count(*) AS c FROM lm_grams GROUP BY ALL),
c2 AS (SELECT w2, w3, count(*) AS c FROM lm_grams WHERE w2 IS NOT NULL GROUP BY ALL), o2 AS (SELECT doc_id, w2, w3, count(*) AS c FROM lm_grams WHERE w2 IS NOT NULL GROUP BY ALL),
c3 AS (SELECT w1, w2, w3, count(*) AS c FROM lm_grams WHERE w1 IS NOT NULL GROUP BY ALL), o3 AS (SELECT doc_id, w1, w2, w3, count(*) AS c FROM lm_grams WHERE w1 IS NOT NULL GROUP BY ALL),
lm_out AS (SELECT g.doc_id, coalesce(c3.c - o3.c, 0) AS t3, coalesce(b2.c - p2.c, 0) AS b2, coalesce(c2.c - o2.c, 0) AS t2, coalesce(b1.c - p1.c, 0) AS b1, c1.c - o1.c AS t1, greatest(lm_n.n - lm_docs.n, 1) AS n
 FROM lm_grams g CROSS JOIN lm_n JOIN lm_docs ON lm_docs.doc_id = g.doc_id
 JOIN c1 ON c1.w3 = g.w3 JOIN o1 ON o1.doc_id = g.doc_id AND o1.w3 = g.w3
 LEFT JOIN c2 ON c2.w2 = g.w2 AND c2.w3 = g.w3 LEFT JOIN o2 ON o2.doc_id = g.doc_id AND o2.w2 = g.w2 AND o2.w3 = g.w3
 LEFT JOIN c3 ON c3.w1 = g.w1 AND c3.w2 = g.w2 AND c3.w3 = g.w3 LEFT JOIN o3 ON o3.doc_id = g.doc_id AND o3.w1 = g.w1 AND o3.w2 = g.w2 AND o3.w3 = g.w3
 LEFT JOIN c1 b1 ON b1.w3 = g.w2 LEFT JOIN o1 p1 ON p1.doc_id = g.doc_id AND p1.w3 = g.w2
 LEFT JOIN c2 b2 ON b2.w2 = g.w1 AND b2.w3 = g.w2 LEFT JOIN o2 p2 ON p2.doc_id = g.doc_id AND p2.w2 = g.w1 AND p2.w3 = g.w2),
lm_scores AS (SELECT d.doc_id, count(t1) AS n_tokens, coalesce(sum(CASE WHEN t3 > 0 THEN log10(t3 / b2) WHEN t2 > 0 THEN log10(t2 / b1) + log10({a}) WHEN t1 > 0 THEN log10(t1 / n) + 2 * log10({a}) WHEN t1 = 0 THEN 3 * log10({a}) - log10(n) END), 0) AS log10_score,
 count(*) FILTER (WHERE t3 > 0) AS n3, count(*) FILTER (WHERE t3 = 0 AND t2 > 0) AS n2, count(*) FILTER (WHERE t3 = 0 AND t2 = 0 AND t1 > 0) AS n1, count(*) FILTER (WHERE t3 = 0 AND t2 = 0 AND t1 = 0) AS n0
 FROM {docs} d LEFT JOIN lm_out o ON o.doc_id = d.doc_id GROUP BY d.doc_id)"""
