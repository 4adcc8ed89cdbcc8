"""How sources of a language differ in their words: mergeable radix tries with counters for each source at their leaves.

Tasks count terms in byte tries, one a language: edges are of eight bytes, a node is a run of terms with the same bytes so far, and
a term's leaf has the documents that hold it and its occurrences by source. Tries are cut at common terms, so that each range of
prefixes is merged by one task into one trie, whatever the number of partitions; the cuts come from a bounded sample of the tries
and only set how even the ranges are. Leaves in trie order are terms in byte order, which is UTF-8 order: those in enough documents
of the language are kept and their counts summed by source; with these sums a second walk streams the values of all pairs of
sources and the best terms of each source, which are ranked over the ranges. A task holds one range of terms at a time, and of
the compared counts a block of terms by the sources of one language.

Null text, lang and source are empty. Rows are documents, repeated ones and those without doc_id too. Documents without terms count
for their group. Other columns are left behind. An empty table gives no rows. All arithmetic is in integers: 64-bit where the
counts allow it, else unbounded; values of part 'pair' fit 64 bits, as the p of a group add up to little more than the unit.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervane.llm.common import portions, release, releasing, save

#: Bytes that are in no term become spaces, capital letters of ASCII small ones.
_FOLD = bytes(32 if b < 0x41 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if b <= 0x5A else b for b in range(256))
_INT64_COUNT = 9_000_000_000  # times the unit still fits


@dataclass(frozen=True)
class Audit:
    """What is compared, and sizes of the work, which don't change the result.

    portion_bytes: of text, counted in one trie a language. range_terms: about as many terms of a merged range.
    sample: terms at most that place the cuts. most_ranges: of a language.
    """

    least_documents: int = 3
    unit: int = 1_000_000_000
    most_terms: int = 200
    portion_bytes: int = 16_000_000
    range_terms: int = 20_000
    sample: int = 20_000
    most_ranges: int = 4096


def ranks(ends: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each of many terms, how many of them come before it in byte order; equal terms have equal ranks.

    ends: where each term ends in data (bytes), which has no zero byte. The trie is built for all terms at once, level by level:
    the terms at a node, a run in the order so far, are sorted by their next eight bytes, while any of them has bytes left.
    """
    n = len(ends)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    left = ends - starts
    rank, live, depth = np.zeros(n, np.int64), np.arange(n), 0
    while len(live):
        rest = left[live] - depth
        at = np.where(rest > 0, starts[live] + depth, len(data))  # beyond the end: zero bytes
        taken = np.minimum(np.maximum(rest, 0), 8)
        edge = np.zeros(len(live), np.uint64)
        for k in range(8):
            edge = (edge << np.uint64(8)) | np.where(k < taken, padded[np.minimum(at + k, len(padded) - 1)], 0).astype(np.uint64)
        order = np.lexsort((edge, rank[live]))
        node, edge, live = rank[live][order], edge[order], live[order]
        fresh = np.concatenate([[True], node[1:] != node[:-1]])
        child = fresh | np.concatenate([[True], edge[1:] != edge[:-1]])
        place = np.arange(len(live))
        first_of_node, first_of_child = np.maximum.accumulate(np.where(fresh, place, 0)), np.maximum.accumulate(np.where(child, place, 0))
        rank[live] = node + first_of_child - first_of_node
        depth += 8
        # Nodes whose terms go on; a single term needs no more.
        run = np.cumsum(child) - 1
        size, more = np.bincount(run), np.bincount(run, left[live] > depth) > 0
        live = live[((size > 1) & more)[run]]
    return rank


_SQUEEZE, _OPEN = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


@dataclass(frozen=True)
class Trie:
    """Leaves in byte order: terms, documents, and entries (source, count) of each: those of leaf k end at upto[k]."""

    ends: np.ndarray
    data: np.ndarray
    documents: np.ndarray
    upto: np.ndarray
    source: np.ndarray
    count: np.ndarray

    @staticmethod
    def of(ends: np.ndarray, data: np.ndarray, documents: np.ndarray, term: np.ndarray, source: np.ndarray, count: np.ndarray) -> Trie:
        """From terms in any order, repeated or not, with documents to be added up, and entries (term number, source, count), too."""
        rank = ranks(ends, data)
        _, first, leaf = np.unique(rank, return_index=True, return_inverse=True)
        sizes = np.diff(ends, prepend=0)
        many = int(source.max(initial=0)) + 1
        key, entry = np.unique(leaf[term] * many + source, return_inverse=True)
        return Trie(
            np.cumsum(sizes[first]),
            _gather(ends, sizes, data, first),
            _sums(leaf, documents, len(first)),
            np.cumsum(np.bincount(key // many, minlength=len(first))),
            key % many,
            _sums(entry, count, len(key)),
        )

    def __len__(self) -> int:
        return len(self.ends)

    def term(self, k: int) -> bytes:
        return self.data[self.ends[k - 1] if k else 0 : self.ends[k]].tobytes()

    def part(self, a: int, z: int) -> Trie:
        """Leaves a to z."""
        byte, entry = (int(x[a - 1]) if a else 0 for x in (self.ends, self.upto))
        last = int(self.upto[z - 1]) if z else 0
        data = self.data[byte : int(self.ends[z - 1]) if z else 0]
        return Trie(self.ends[a:z] - byte, data, self.documents[a:z], self.upto[a:z] - entry, self.source[entry:last], self.count[entry:last])

    def where(self, keep: np.ndarray) -> Trie:
        """The leaves marked."""
        sizes, entries = np.diff(self.ends, prepend=0), np.diff(self.upto, prepend=0)
        kept = np.nonzero(keep)[0]
        mine = np.repeat(keep, entries)
        data = _gather(self.ends, sizes, self.data, kept)
        return Trie(np.cumsum(sizes[kept]), data, self.documents[kept], np.cumsum(entries[kept]), self.source[mine], self.count[mine])

    def dump(self) -> bytes:
        sizes = np.array([len(self.ends), len(self.data), len(self.source)], "<i8")
        small = [np.diff(x, prepend=0).astype("<u4") for x in (self.ends, self.upto)]
        return _SQUEEZE.compress(b"".join(x.tobytes() for x in (sizes, *small, self.source.astype("<u4"), self.documents.astype("<i8"), self.count.astype("<i8"), self.data)))

    @staticmethod
    def load(raw: bytes) -> Trie:
        raw = _OPEN.decompress(raw)
        n, n_bytes, n_entries = np.frombuffer(raw, "<i8", 3).tolist()
        parts, at = [], 24
        for kind, size in (("<u4", n), ("<u4", n), ("<u4", n_entries), ("<i8", n), ("<i8", n_entries), ("u1", n_bytes)):
            parts.append(np.frombuffer(raw, kind, size, at))
            at += parts[-1].nbytes
        sizes, entries, source, documents, count, data = parts
        return Trie(np.cumsum(sizes, dtype=np.int64), data, documents, np.cumsum(entries, dtype=np.int64), source.astype(np.int64), count)


def _gather(ends: np.ndarray, sizes: np.ndarray, data: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Bytes of the terms of these numbers, end to end."""
    n = sizes[which]
    upto = np.cumsum(n)
    return data[np.repeat(ends[which] - upto, n) + np.arange(upto[-1] if len(upto) else 0)]


def _sums(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of n by place."""
    out = np.zeros(size, np.int64)
    np.add.at(out, at, n)
    return out


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers in order, and how many there are of each."""
    x = np.sort(x)
    first = np.nonzero(np.concatenate([[True], x[1:] != x[:-1]]))[0] if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(first, append=len(x))


def merge(tries: list[tuple[list[str], Trie]]) -> tuple[list[str], Trie]:
    """One trie of many, each with the names of its sources."""
    names: dict[str, int] = {}
    ends, data, documents, term, source, count = [], [], [], [], [], []
    bytes_before = terms_before = 0
    for sources, t in tries:
        own = np.array([names.setdefault(s, len(names)) for s in sources] or [0], np.int64)
        ends.append(t.ends + bytes_before)
        term.append(np.repeat(np.arange(len(t)), np.diff(t.upto, prepend=0)) + terms_before)
        source.append(own[t.source])
        data.append(t.data)
        documents.append(t.documents)
        count.append(t.count)
        bytes_before, terms_before = bytes_before + len(t.data), terms_before + len(t)
    return list(names), Trie.of(*map(np.concatenate, (ends, data, documents, term, source, count)))


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of texts (no nulls), in order, repeats included, and the number of the text of each."""
    at = np.frombuffer(texts.buffers()[1], "<i4")[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    folded = pa.py_buffer(data[int(at[0]) : int(at[-1])].to_pybytes().translate(_FOLD)) if data is not None else pa.py_buffer(b"")
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer((at - at[0]).tobytes()), folded]))
    flat, of = lists.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), of[full.to_numpy(zero_copy_only=False)]


def count(langs: list[str], sources: list[str], texts: pa.Array) -> Iterator[tuple[str, list[str], Trie]]:
    """(lang, sources, trie) of each language of these documents."""
    pairs = sorted(set(zip(langs, sources)))
    number = {p: k for k, p in enumerate(pairs)}
    group = np.array([number[p] for p in zip(langs, sources)], np.int64)
    lang_no = {x: k for k, x in enumerate(dict.fromkeys(x for x, _ in pairs))}
    lang_of = np.array([lang_no[x] for x, _ in pairs], np.int64)
    flat, doc = words(texts)
    coded = flat.dictionary_encode()
    terms, word = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    many = max(1, len(terms))
    by_group, n = _distinct(group[doc] * many + word)
    once, _ = _distinct(doc * many + word)
    by_lang, documents = _distinct(lang_of[group[once // many]] * many + once % many)
    ends = np.frombuffer(terms.buffers()[1], "<i4", len(terms) + 1)[1:].astype(np.int64) if len(terms) else np.zeros(0, np.int64)
    data = np.frombuffer(terms.buffers()[2], np.uint8) if len(terms) and terms.buffers()[2] else np.zeros(0, np.uint8)
    sizes = np.diff(ends, prepend=0)
    for lang, k in lang_no.items():
        own = by_lang // many == k
        mine = by_lang[own] % many
        first = next(i for i, (x, _) in enumerate(pairs) if x == lang)
        entries = lang_of[by_group // many] == k
        term = np.searchsorted(mine, by_group[entries] % many)
        trie = Trie.of(np.cumsum(sizes[mine]), _gather(ends, sizes, data, mine), documents[own], term, by_group[entries] // many - first, n[entries])
        yield lang, [s for x, s in pairs if x == lang], trie


_TRIES = pa.schema([("lang", pa.string()), ("sources", pa.list_(pa.string())), ("n_terms", pa.int64()), ("trie", pa.binary())])


def _count(how: Audit):
    """Partitions to tries: (lang, sources seen, terms, dump)."""

    def run(batches):
        for batch in batches:
            for some in portions(batch, "text", how.portion_bytes):
                found = list(count(some.column("lang").to_pylist(), some.column("source").to_pylist(), some.column("text")))
                rows = [(lang, sources, len(t), t.dump()) for lang, sources, t in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_TRIES)], schema=_TRIES)
        release()

    return run


def tries(docs: DataFrame, how: Audit) -> DataFrame:
    """(lang, sources, n_terms, trie) of each partition and language, written to the shared folder."""
    empty = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return save(docs.select(*empty).mapInArrow(_count(how), "lang string, sources array<string>, n_terms long, trie binary"), "tries")


def cuts(made: DataFrame, how: Audit) -> dict[str, list[bytes]]:
    """Terms at which the ranges of each language begin: quantiles of terms sampled from tries, at most how.sample in all."""
    sizes = {r.lang: (r.n, r.most) for r in made.groupBy("lang").agg(F.sum("n_terms").alias("n"), F.max("n_terms").alias("most")).collect()}  # a row a language
    all_terms = sum(n for n, _ in sizes.values())
    every = max(1, -(-all_terms // how.sample))

    def some(batches):
        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("trie").to_pylist()):
                trie = Trie.load(raw)
                terms = [trie.term(k) for k in range(every // 2, len(trie), every)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array(terms, pa.binary())], names=["lang", "term"])

    if all_terms <= how.range_terms:
        return {lang: [] for lang in sizes}
    sampled: dict[str, list[bytes]] = {}
    for r in made.select("lang", "trie").mapInArrow(some, "lang string, term binary").limit(2 * how.sample).collect():
        sampled.setdefault(r.lang, []).append(bytes(r.term))
    out = {}
    for lang, (n, _) in sizes.items():
        terms = sorted(sampled.get(lang, []))
        ranges = min(how.most_ranges, -(-n // how.range_terms), len(terms) or 1)
        out[lang] = sorted({terms[k * len(terms) // ranges] for k in range(1, ranges)})
    return out


_PIECES = pa.schema([("lang", pa.string()), ("sources", pa.list_(pa.string())), ("prefix_range", pa.int32()), ("trie", pa.binary())])
_KEPT = pa.schema([("lang", pa.string()), ("prefix_range", pa.int32()), ("n_terms", pa.int64()), ("sources", pa.list_(pa.string())), ("sums", pa.list_(pa.int64())), ("trie", pa.binary())])


def _cut(at: dict[str, list[bytes]]):
    """Tries to the pieces of them that fall in each range."""

    def run(batches):
        for batch in batches:
            for lang, sources, raw in zip(*(batch.column(c).to_pylist() for c in ("lang", "sources", "trie"))):
                trie = Trie.load(raw)
                bounds = [0, *(bisect_left(range(len(trie)), b, key=trie.term) for b in at[lang]), len(trie)]
                rows = [(lang, sources, k, trie.part(a, z).dump()) for k, (a, z) in enumerate(zip(bounds, bounds[1:])) if z > a]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PIECES)], schema=_PIECES)

    return run


def _merge(how: Audit):
    """Pieces of one language and range to one trie of the terms that are kept, with the sums of its counts by source."""

    def run(table: pa.Table) -> pa.Table:
        names, trie = merge([(s, Trie.load(t)) for s, t in zip(table["sources"].to_pylist(), table["trie"].to_pylist())])
        kept = trie.where(trie.documents >= how.least_documents)
        row = (table["lang"][0].as_py(), table["prefix_range"][0].as_py(), len(kept), names, _sums(kept.source, kept.count, len(names)).tolist(), kept.dump())
        return pa.table([pa.array([v], f.type) for v, f in zip(row, _KEPT)], schema=_KEPT)

    return run


def _shares(counts: np.ndarray, total: int, n_terms: int, unit: int) -> np.ndarray:
    """p of each count: 1 + floor(unit * (count + 1) / (total + n_terms))."""
    return 1 + unit * (counts + 1) // max(1, total + n_terms)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


_OUT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
_BLOCK = 1024


def _compare(how: Audit):
    """A kept range with all sources of its language and their sums to pair values and each source's best terms of the range."""

    def one(lang: str, sources: list[str], sums: list[int], n_terms: int, own: list[str] | None, raw: bytes | None) -> Iterator[pa.RecordBatch]:
        place = {s: k for k, s in enumerate(sources)}
        to = np.array([place[s] for s in own or ()], np.int64)
        pairs = np.zeros((len(sources), len(sources)), np.int64)
        total = sum(sums)
        best: list[list[tuple[int, bytes]]] = [[] for _ in sources]
        trie = Trie.load(raw) if raw else None
        for first in range(0, len(trie) if trie else 0, _BLOCK):
            block = trie.part(first, min(first + _BLOCK, len(trie)))
            wide = total >= _INT64_COUNT
            counts = np.zeros((len(sources), len(block)), object if wide else np.int64)
            counts[to[block.source], np.repeat(np.arange(len(block)), np.diff(block.upto, prepend=0))] = block.count
            p = np.stack([_shares(c, t, n_terms, how.unit) for c, t in zip(counts, sums)])
            whole = _shares(counts.sum(axis=0), total, n_terms, how.unit)
            for k in range(len(sources)):
                pairs[k] += _apart(p[k][None], p).sum(axis=1).astype(np.int64)
                f = _apart(p[k], whole)
                more = np.nonzero((counts[k] > 0) & (p[k] > whole))[0]
                # Terms come in order, and sorting keeps the order of equal values.
                more = more[np.argsort(-f[more], kind="stable")[: how.most_terms]]
                best[k] = sorted(best[k] + [(int(f[j]), block.term(j)) for j in more.tolist()], key=lambda x: -x[0])[: how.most_terms]
        for k, s in enumerate(sources):
            rows = [(lang, s, "pair", t, int(pairs[k, j])) for j, t in enumerate(sources) if j != k]
            rows += [(lang, s, "term", t.decode("utf-8", "surrogatepass"), v) for v, t in best[k]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_OUT)], schema=_OUT)

    def run(batches):
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("lang", "of_sources", "of_sums", "of_terms", "sources", "trie"))):
                yield from one(*row)
        release()

    return run


def compare(docs: DataFrame, how: Audit | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): see the module's text.

    p of a group or language is 1 + floor(unit * (count + 1) / (N + V)), with V kept terms of the language and N their occurrences
    there. Part 'pair': item is another source of the language, q its p, value the sum of floor((p - q)^2 / q) over all kept terms.
    Part 'term': item is a kept term that the group has and whose p is over q, that of the language; only the best most_terms.
    """
    how = how or Audit()
    made = tries(docs, how)
    at = cuts(made, how)
    pieces = made.select("lang", "sources", "trie").mapInArrow(_cut(at), "lang string, sources array<string>, prefix_range int, trie binary")
    types = "lang string, prefix_range int, n_terms long, sources array<string>, sums array<long>, trie binary"
    kept = save(pieces.groupBy("lang", "prefix_range").applyInArrow(releasing(_merge(how)), types), "kept")
    groups = made.select("lang", F.explode("sources").alias("source")).distinct()
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("n"))
    terms = kept.groupBy("lang").agg(F.sum("n_terms").alias("of_terms"))
    by_source = groups.join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("g"))
    of_lang = save(by_source.join(terms, "lang", "left").select("lang", F.col("g.source").alias("of_sources"), F.col("g.n").alias("of_sums"), F.coalesce("of_terms", F.lit(0)).cast("long").alias("of_terms")), "languages")
    # A language's sources go to each of its ranges; a language without kept terms has an empty one.
    ranges = kept.select("lang", "prefix_range").union(of_lang.select("lang", F.lit(-1)))
    rows = ranges.join(of_lang, "lang").join(kept.select("lang", "prefix_range", "sources", "trie"), ["lang", "prefix_range"], "left")
    out = rows.mapInArrow(_compare(how), "lang string, source string, part string, item string, value long")
    pairs = out.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    w = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda d: d.withColumn("rank", F.row_number().over(w))
    return ranked(pairs).unionByName(ranked(out.where("part = 'term'")).where(F.col("rank") <= how.most_terms))


def sql() -> str:
    """The same rows over documents in DuckDB."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""WITH d AS (SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{letters}', '{letters.lower()}') AS body FROM documents),
t AS (SELECT lang, source, row_no, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row_no) >= 3), nv AS (SELECT lang, count(*) AS v FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d), c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
f AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n FROM g JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM f JOIN nv USING (lang)),
w AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang) + v) AS q FROM (SELECT lang, term, sum(n) AS n FROM f GROUP BY lang, term) JOIN nv USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
 UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p JOIN w USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r QUALIFY part = 'pair' OR rank <= 200"""
