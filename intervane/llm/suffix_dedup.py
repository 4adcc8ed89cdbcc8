"""Removal of passages that repeat across documents, by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a string of ``span`` bytes that covers it also starts in a document with a smaller doc_id. Sorting every suffix
would write many times the input, so suffixes are taken at anchors: in each window of span bytes, the place whose gram (the
next 24 bytes) hashes lowest. Equal windows have equal anchors, so no repeat is missed. Steps, over chunks of documents:

1. every chunk sends its distinct anchor grams, hashed and front-coded, to buckets; a bucket answers which occur in two
   documents or more, and which so often that one bucket should not hold all suffixes that start with them.
2. for the anchors of such frequent grams, every chunk sends the hashes of all windows about them, and learns which occur in two
   documents. These windows stand for the anchor from here on, each under its own hash, so that no bucket has more than one row
   a chunk of any key.
3. every chunk sorts the suffixes at the anchors that are left (span bytes to the right, then the bytes to the left, nearest
   first), each distinct one once with its smallest doc_id, and sends them to buckets as front-coded sorted runs.
4. a bucket merges its runs with a loser tree whose entries carry the common prefix with the last winner: two entries with
   different prefixes are ordered by these numbers alone, and equal ones are compared only beyond them; the prefix of a run's
   next entry is the one that its front coding holds. The merged order and its common prefixes give, for each place of the
   window about the anchor, which suffixes are equal there, and so which windows occur in a smaller document. Left contexts are
   told apart by their bytes, in a second sorted order with its common prefixes.
5. every chunk marks its windows and cuts the marked bytes.

Blocks travel by ``exchange``: beyond 256 chunks, runs are merged level by level, and each level splits what it has merged.
The texts are shuffled once; steps 1, 2, 3 and 5 read the same shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervane.llm.common import docs_of, releasing, releasing_pair
from intervane.llm.exchange import BLOCKS, MOST, Fan, answered, blocks_table, deal, key_blocks, marks_of, small, texts, unfront, unsmall
from intervane.llm.lm_scoring import _LETTERS, _mix, _power

_U = np.uint64
GRAM = 24
_LETTERS_ALL = _LETTERS.copy()
_LETTERS_ALL[65:91] = _mix(_LETTERS[65:91]) | _U(1)  # capitals differ here
_STEP = 1 << 18
#: Bits of the hashes that only choose what goes on: equal hashes of different bytes cost a suffix, not a byte of the result.
_KEY_BITS = 48
_HIGH = _U((1 << 64) - (1 << (64 - _KEY_BITS)))
#: A gram with more anchors than this in the corpus is taken window by window.
FREQUENT = 4096
_WINDOW = 255  # in place of the number of bytes to the left: the row is a window, and has none
_NULL_ID = -(1 << 63)
_NONE, _SHARED, _OFTEN = 0, 1, 2

_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_KEPT = pa.schema([*_RESULT, pa.field("kept", pa.binary()), pa.field("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


class _Chunk:
    """Documents end to end, their anchors, and what identifies them."""

    def __init__(self, table: pa.Table, span: int):
        parts = texts(table)
        self.span, self.names = span, table["doc_id"]
        self.ids = np.array([_NULL_ID if k is None else k for k in table["doc_id"].to_pylist()], dtype=np.int64)
        self.ends = np.cumsum([len(t) for t in parts], dtype=np.int64)
        self.starts = self.ends - np.array([len(t) for t in parts], dtype=np.int64)
        self.bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)
        whole = np.zeros(len(self.bytes), dtype=bool)  # windows that lie in one document
        for a, b in zip(self.starts, self.ends):
            whole[a : max(a, b - span + 1)] = True
        at, keys = [], []
        for first in range(0, len(self.bytes), _STEP):
            ok = np.nonzero(whole[first : first + _STEP])[0]
            if len(ok):
                a, k = self._minima(first, ok)
                at.append(a)
                keys.append(k)
        self.at = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        if len(self.at):
            new = np.concatenate([[True], self.at[1:] != self.at[:-1]])
            self.at, self.keys = self.at[new], self.keys[new]
        self.doc = np.searchsorted(self.ends, self.at, side="right")

    def _minima(self, first: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, gram keys) of the lowest gram of each window, each place once; windows count from first."""
        part = self.bytes[first : first + _STEP + self.span]
        key = _keys(part, GRAM)
        n = len(key)
        low = (key & _U((1 << 64) - (1 << 21))) | np.arange(n, dtype=np.uint64)
        width, done = self.span - GRAM + 1, 1
        while done * 2 <= width:
            low = np.minimum(low[:-done], low[done:])
            done *= 2
        if done < width:
            low = np.minimum(low[: len(low) - (width - done)], low[width - done :])
        at = (low[windows] & _U((1 << 21) - 1)).astype(np.int64)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        return at + first, _mix(key[at]) & _HIGH  # the lowest hashes are crowded at the low end, so they are mixed again

    def window_starts(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of all windows of one document that hold the gram at one of the anchors (numbers of them), ascending."""
        first, last = self.starts[self.doc[anchors]], self.ends[self.doc[anchors]] - self.span
        found = np.zeros(len(self.bytes) + 1, bool)
        for j in range(self.span - GRAM + 1):
            at = self.at[anchors] - j
            found[at[(at >= first) & (at <= last)]] = True
        return np.nonzero(found)[0]

    def window_keys(self, starts: np.ndarray) -> np.ndarray:
        out = [np.zeros(0, np.uint64)]
        for first in range(0, len(self.bytes), _STEP):
            here = starts[np.searchsorted(starts, first) : np.searchsorted(starts, first + _STEP)] - first
            if len(here):
                out.append(_keys(self.bytes[first : first + _STEP + self.span], self.span)[here] & _HIGH)
        return np.concatenate(out)

    def owners(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")

    def suffixes(self, shared: np.ndarray, windows: np.ndarray, window_keys: np.ndarray, cuts: np.ndarray):
        """Distinct suffixes at the anchors where shared, and windows: (places, rows, bucket of each row, smallest doc_id of each row, row of each place).

        A row: span bytes from the place on, the bytes before it nearest first, and how many of either are its document's;
        the others are zero. A window has no bytes before it. Rows are sorted by bucket, then bytes.
        """
        span, left = self.span, self.span - GRAM
        at = np.concatenate([self.at[shared], windows])
        if not len(at):
            return at, np.zeros((0, span + left + 2), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc = self.owners(at)
        single = np.arange(len(at)) >= len(shared)
        before, after = np.where(single, 0, np.minimum(at - self.starts[doc], left)), np.minimum(self.ends[doc] - at, span)
        padded = np.concatenate([np.zeros(left, np.uint8), self.bytes, np.zeros(span, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(padded, left + span)[at]
        rows = np.empty((len(at), span + left + 2), np.uint8)
        rows[:, :span] = np.where(np.arange(span) < after[:, None], view[:, left:], 0)
        rows[:, span:-2] = np.where(np.arange(left) < before[:, None], view[:, left - 1 :: -1], 0)[:, :left]
        rows[:, -2], rows[:, -1] = np.where(single, _WINDOW, before), after
        bucket = np.searchsorted(cuts, np.concatenate([self.keys[shared], window_keys]), side="right")
        order = _by_bytes(rows)
        order = order[np.argsort(bucket[order], kind="stable")]
        rows, owner = rows[order], self.ids[doc[order]]
        new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
        begin = np.nonzero(new)[0]
        row_of = np.empty(len(at), np.int64)
        row_of[order] = np.cumsum(new) - 1
        return at, rows[begin], bucket[order][begin], np.minimum.reduceat(owner, begin), row_of


def _keys(part: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of the width bytes from each place of part on."""
    power, inverse = _power(len(part) + 1)
    total = np.concatenate([[_U(0)], np.cumsum(_LETTERS_ALL[part] * power[: len(part)], dtype=np.uint64)])
    n = len(part) - width + 1
    return _mix((total[width:] - total[:n]) * inverse[:n])


def _row_keys(rows: np.ndarray, span: int) -> np.ndarray:
    """The key under which each row travels: that of its gram, or of its window."""
    letters = _LETTERS_ALL[rows[:, :span]] * _power(span)[0][:span]
    gram = _mix(_mix(letters[:, :GRAM].sum(axis=1, dtype=np.uint64)))
    return np.where(rows[:, -2] == _WINDOW, _mix(letters.sum(axis=1, dtype=np.uint64)), gram) & _HIGH


def _by_bytes(rows: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")


def distinct_keys(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys; for each, twice its count, and one if two owners have it; place of each key among them)."""
    found, where, count = np.unique(keys, return_inverse=True, return_counts=True)
    if not len(found):
        return found, count, where
    order = np.argsort(where, kind="stable")
    begin = np.cumsum(count) - count
    return found, 2 * count + (np.minimum.reduceat(owner[order], begin) != np.maximum.reduceat(owner[order], begin)), where


class _Grams:
    """Blocks of hashes with their counts: the answer to each is whether two documents have it, and whether it is frequent."""

    def __init__(self, frequent: int):
        self.frequent = frequent

    def combine(self, table: pa.Table, cuts: np.ndarray | None) -> tuple:
        sizes = table["n"].to_pylist()
        keys = np.concatenate([unfront(x, _KEY_BITS) for x in table["keys"].to_pylist()])
        extra = np.concatenate([unsmall(x, n) for x, n in zip(table["extra"].to_pylist(), sizes)])
        keys, where, senders = np.unique(keys, return_inverse=True, return_counts=True)
        several = (senders > 1) | (np.bincount(where, extra & 1) > 0)
        return keys, 2 * np.bincount(where, extra >> 1).astype(np.int64) + several, where, np.cumsum(sizes)

    def send(self, state: tuple, sender: int, first_bucket: int, cuts: np.ndarray) -> pa.Table:
        return key_blocks(sender, first_bucket, state[0], state[1], cuts, _KEY_BITS)

    def settle(self, state: tuple) -> np.ndarray:
        several = state[1] & 1
        return np.where(several & (state[1] >> 1 > self.frequent), _OFTEN, several)

    def read(self, marks: list[tuple[int, bytes]]) -> np.ndarray:
        return np.concatenate([unsmall(m, n) for n, m in marks]) if marks else np.zeros(0, np.int64)

    def give(self, state: tuple, answers: np.ndarray) -> list[bytes]:
        if len(answers) != len(state[0]):
            raise RuntimeError("the answers do not fit the blocks")
        return [small(x) for x in np.split(answers[state[2]], state[3][:-1])]


class _Suffixes:
    """Sorted runs of rows with their smallest doc_id: the answer to a row has a bit for each of its windows that a smaller document has."""

    def __init__(self, span: int):
        self.span, self.width = span, 2 * span - GRAM + 2

    def combine(self, table: pa.Table, cuts: np.ndarray | None) -> dict:
        sizes = table["n"].to_pylist()
        each, common = zip(*(front_decode(raw, n, self.width) for raw, n in zip(table["keys"].to_pylist(), sizes)))
        docs = np.concatenate([np.frombuffer(x, np.int64) for x in table["extra"].to_pylist()])
        source, prefix = loser_tree_merge([[r.tobytes() for r in rows] for rows in each], [c.tolist() for c in common])
        source, prefix, ends = np.array(source), np.array(prefix), np.cumsum(sizes)
        place = np.empty(len(source), np.int64)
        for k, n in enumerate(sizes):
            place[source == k] = ends[k] - n + np.arange(n)
        new = prefix < self.width
        new[0] = True
        where = np.empty(len(source), np.int64)
        where[place] = np.cumsum(new) - 1
        all_rows = np.concatenate(each)
        rows, least = all_rows[place[new]], np.minimum.reduceat(docs[place], np.nonzero(new)[0])
        state = {"rows": rows, "docs": least, "prefix": prefix[new], "where": where, "ends": ends, "sent": docs, "valid": _valid(all_rows, self.span)}
        if cuts is not None:
            state["bucket"] = np.searchsorted(cuts, _row_keys(rows, self.span), side="right")
            order = np.argsort(state["bucket"], kind="stable")
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            state |= {"rows": rows[order], "docs": least[order], "bucket": state["bucket"][order], "where": back[where]}
        return state

    def send(self, state: dict, sender: int, first_bucket: int, cuts: np.ndarray) -> pa.Table:
        return run_blocks(sender, first_bucket, state["rows"], state["bucket"], state["docs"], len(cuts) + 1)

    def settle(self, state: dict) -> np.ndarray:
        return _windows_seen(state["rows"], state["prefix"], state["docs"], self.span)

    def read(self, marks: list[tuple[int, bytes]]) -> np.ndarray:
        return np.concatenate([np.frombuffer(m, np.uint32) for _, m in marks]) if marks else np.zeros(0, np.uint32)

    def give(self, state: dict, answers: np.ndarray) -> list[bytes]:
        if len(answers) != len(state["rows"]):
            raise RuntimeError("the answers do not fit the blocks")
        where = state["where"]
        marks = np.where(state["sent"] > state["docs"][where], state["valid"], answers[where]).astype(np.uint32)
        return [x.tobytes() for x in np.split(marks, state["ends"][:-1])]


def run_blocks(sender: int, first_bucket: int, rows: np.ndarray, bucket: np.ndarray, docs: np.ndarray, buckets: int) -> pa.Table:
    """A front-coded sorted run for each bucket that has rows."""
    at = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
    cut = zip(range(buckets), at, at[1:])
    return blocks_table([(first_bucket + b, sender, z - a, front_code(rows[a:z]), docs[a:z].tobytes()) for b, a, z in cut if z > a])


def _valid(rows: np.ndarray, span: int) -> np.ndarray:
    """A bit for each number of bytes to the left at which a row's window starts and lies in its document."""
    before, after = _reach(rows)
    out = np.zeros(len(rows), np.uint32)
    for j in range(span - GRAM + 1):
        out |= ((before >= j) & (after >= span - j)).astype(np.uint32) << np.uint32(j)
    return out


def _reach(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.where(rows[:, -2] == _WINDOW, 0, rows[:, -2]).astype(np.int64), rows[:, -1].astype(np.int64)


def front_code(rows: np.ndarray) -> bytes:
    """Sorted rows: the common prefix of each with the one before, then the bytes beyond it."""
    common = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        common[1:] = np.argmax(rows[1:] != rows[:-1], axis=1)
    return common.tobytes() + rows[np.arange(rows.shape[1]) >= common[:, None]].tobytes()


def front_decode(raw: bytes, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, common prefix of each with the one before)."""
    common = np.frombuffer(raw, np.uint8, n)
    rows = np.zeros((n, width), np.uint8)
    own = np.arange(width) >= common[:, None]
    rows[own] = np.frombuffer(raw, np.uint8, offset=n)
    for c in range(width):
        last = np.maximum.accumulate(np.where(own[:, c], np.arange(n), 0))
        rows[:, c] = rows[last, c]
    return rows, common


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, looking only beyond the known one; rows end with all bytes equal."""
    n = len(a)
    while known < n and a[known : known + 8] == b[known : known + 8]:
        known += 8
    while known < n and a[known] == b[known]:
        known += 1
    return min(known, n)


def loser_tree_merge(runs: list[list[bytes]], common: list[list[int]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs of equal-length rows: (run of each output, common prefix with the output before).

    common: the common prefix of each row of a run with the one before it; known, so never looked for again. Every entry keeps its common prefix with the last row that went out along its path. Of two entries, the one with the longer
    prefix is smaller; only equal prefixes are compared, from there on, and the loser keeps the prefix it shares with the winner.
    """
    k = len(runs)
    size = 1 << max(0, (k - 1).bit_length())
    width = len(runs[0][0]) if k else 0
    heads: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (size - k)
    known = [0] * size
    at = [0] * k
    tree = [0] * size  # losers; tree[0] is the winner

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes the one with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = known[a], known[b]
        if p > q:
            return a, b
        if q > p:
            return b, a
        c = _common(x, y, p)
        if c == width or x[c] < y[c]:
            known[b] = c
            return a, b
        known[a] = c
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        w, tree[node] = play(build(2 * node), build(2 * node + 1))
        return w

    winner = build(1)
    source, prefix = [], []
    total = sum(map(len, runs))
    for _ in range(total):
        source.append(winner)
        prefix.append(known[winner])
        run = runs[winner]
        at[winner] += 1
        i = at[winner]
        if i < len(run):
            heads[winner] = run[i]
            known[winner] = common[winner][i]
        else:
            heads[winner] = None
        node = (winner + size) >> 1
        while node:
            other = tree[node]
            # Inlined: most games are decided by the prefixes alone.
            p, q = known[winner], known[other]
            if heads[other] is not None and (heads[winner] is None or q > p):
                tree[node], winner = winner, other
            elif p == q and heads[winner] is not None and heads[other] is not None:
                winner, tree[node] = play(winner, other)
            node >>= 1
    return source, prefix


def _windows_seen(rows: np.ndarray, prefix: np.ndarray, docs: np.ndarray, span: int) -> np.ndarray:
    """For each of the distinct rows in sorted order, a bit for each number of bytes to the left that its window starts: it occurs in a smaller document."""
    left = span - GRAM
    out = np.zeros(len(rows), np.uint32)
    group = np.cumsum(prefix < GRAM)
    many = np.nonzero(np.bincount(group)[group] > 1)[0]
    if not len(many):
        return out
    # All rows of a group stay, so that the prefix between neighbours is still the one between rows.
    rows, prefix, docs = rows[many], prefix[many], docs[many]
    marks = np.zeros(len(rows), np.uint32)
    before, after = _reach(rows)
    contexts = np.ascontiguousarray(rows[:, span : span + left])
    by_left = _by_bytes(contexts)
    differs = contexts[by_left[1:]] != contexts[by_left[:-1]]
    left_prefix = np.concatenate([[0], np.where(differs.any(axis=1), differs.argmax(axis=1), left)])
    side = np.empty(len(rows), np.int64)
    for j in range(left + 1):
        ok = np.nonzero((before >= j) & (after >= span - j))[0]
        if not len(ok):
            continue
        side[by_left] = np.cumsum(left_prefix < j)
        key = (np.cumsum(prefix < span - j) * (len(rows) + 1) + side)[ok]
        order = np.argsort(key, kind="stable")
        same = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        begin = np.nonzero(same)[0]
        least = np.minimum.reduceat(docs[ok][order], begin)[np.cumsum(same) - 1]
        seen = ok[order][least < docs[ok][order]]
        marks[seen] |= np.uint32(1 << j)
    out[many] = marks
    return out


def _plan(docs: DataFrame, span: int, chunk_bytes: int, most: int, frequent: int, emit, schema: str) -> DataFrame:
    if not GRAM < span <= GRAM + 31:
        raise ValueError("span must be 25 to 55 bytes")
    d = docs_of(docs)
    fan = Fan.of(d, d.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0, chunk_bytes, most)
    d = deal(d, fan)
    cuts = fan.cuts(0)

    def of_kind(answers: pa.Table, kind: int) -> list[tuple[int, bytes]]:
        return marks_of(answers.filter(pc.equal(answers["kind"], kind)))

    def gram_answers(of: _Chunk, answers: pa.Table, where: np.ndarray, n: int, kind: int) -> np.ndarray:
        got = _Grams(0).read(of_kind(answers, kind))
        if len(got) != n:
            raise RuntimeError("the answers do not fit the chunk")
        return got[where]

    def grams(table: pa.Table) -> pa.Table:
        of = _Chunk(table, span)
        keys, extra, _ = distinct_keys(of.keys, of.ids[of.doc])
        return key_blocks(table["chunk"][0].as_py(), 0, keys, extra, cuts, _KEY_BITS)

    def often(of: _Chunk, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(anchors to go on as they are, starts of the windows about the others of frequent grams)."""
        keys, _, where = distinct_keys(of.keys, of.ids[of.doc])
        got = gram_answers(of, answers, where, len(keys), 0)
        return np.nonzero(got == _SHARED)[0], of.window_starts(np.nonzero(got == _OFTEN)[0])

    def windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return blocks_table([])
        of = _Chunk(table, span)
        starts = often(of, answers)[1]
        keys, extra, _ = distinct_keys(of.window_keys(starts), of.ids[of.owners(starts)])
        return key_blocks(table["chunk"][0].as_py(), 0, keys, extra, cuts, _KEY_BITS)

    def survivors(of: _Chunk, answers: pa.Table):
        shared, starts = often(of, answers)
        window_keys = of.window_keys(starts)
        keys, _, where = distinct_keys(window_keys, of.ids[of.owners(starts)])
        on = gram_answers(of, answers, where, len(keys), 1) != _NONE
        return of.suffixes(shared, starts[on], window_keys[on], cuts)

    def runs(table: pa.Table, answers: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return blocks_table([])
        _, rows, bucket, docs_, _ = survivors(_Chunk(table, span), answers)
        return run_blocks(table["chunk"][0].as_py(), 0, rows, bucket, docs_, len(cuts) + 1)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return emit(None, None)
        of = _Chunk(table, span)
        at, rows, _, docs_, row_of = survivors(of, answers)
        marks = _Suffixes(span).read(of_kind(answers, 2))
        if len(marks) != len(rows):
            raise RuntimeError("the answers do not fit the chunk")
        gone = np.zeros(len(of.bytes) + span + 1, np.int32)
        if len(at):
            # In the chunk itself a smaller document has the same suffix, or other documents have the window.
            later = of.ids[of.owners(at)] > docs_[row_of]
            seen = np.where(later, _valid(rows, span)[row_of], marks[row_of])
            start = np.zeros(len(of.bytes) + 1, bool)
            for j in range(span - GRAM + 1):
                start[at[seen >> np.uint32(j) & np.uint32(1) > 0] - j] = True
            first = np.nonzero(start)[0]
            gone[first] += 1
            gone[first + span] -= 1
        return emit(of, np.cumsum(gone)[: len(of.bytes)] > 0)

    def ask(f, answers: DataFrame) -> DataFrame:
        return d.groupBy("chunk").cogroup(answers.repartition(fan.partitions, "sender").groupBy("sender")).applyInArrow(releasing_pair(f), BLOCKS)

    def tell(blocks: DataFrame, how, kind: int) -> DataFrame:
        return answered(blocks, fan, how).withColumn("kind", F.lit(kind))

    known = tell(d.groupBy("chunk").applyInArrow(releasing(grams), BLOCKS), _Grams(frequent), 0)
    known = known.union(tell(ask(windows, known), _Grams(1 << 62), 1))
    merged = known.union(tell(ask(runs, known), _Suffixes(span), 2)).repartition(fan.partitions, "sender")
    return d.groupBy("chunk").cogroup(merged.groupBy("sender")).applyInArrow(releasing_pair(cut), schema)


def _rows(of: _Chunk | None, gone: np.ndarray | None, full: bool) -> pa.Table:
    schema = _KEPT if full else _RESULT
    if of is None:
        return schema.empty_table()
    out = []
    for name, a, b in zip(of.names.to_pylist(), of.starts, of.ends):
        g = gone[a:b]
        edge = np.diff(np.concatenate([[False], g, [False]]).astype(np.int8))
        begin = np.nonzero(edge == 1)[0]
        kept = of.bytes[a:b][~g].tobytes()
        row = (name, int(b - a), int(g.sum()), len(begin), hashlib.sha256(kept).hexdigest())
        out.append((*row, kept, [{"start": int(x), "stop": int(y)} for x, y in zip(begin, np.nonzero(edge == -1)[0])]) if full else row)
    return pa.table([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed(docs: DataFrame, span: int = 50, chunk_bytes: int = 5 << 20, most: int = MOST, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs.

    Null and empty texts have no bytes. Rows without doc_id count as before all others, and rows that share a doc_id do not
    remove each other's text. Strings are judged on the input, not on what is left. chunk_bytes: text worked on at a time by a
    task; a longer document is a chunk of its own. most: ways a chunk splits its suffixes. frequent: anchors of a gram beyond
    which its windows are told apart one by one; no choice changes the result.
    """
    return _plan(docs, span, chunk_bytes, most, frequent, lambda of, gone: _rows(of, gone, False), RESULT)


def deduplicate(docs: DataFrame, span: int = 50, chunk_bytes: int = 5 << 20, most: int = MOST, frequent: int = FREQUENT) -> DataFrame:
    """As removed(), with the remaining bytes (kept; a cut may fall within a UTF-8 character) and the removed byte spans."""
    schema = RESULT + ", kept binary, spans array<struct<start:long,stop:long>>"
    return _plan(docs, span, chunk_bytes, most, frequent, lambda of, gone: _rows(of, gone, True), schema)
