"""SimHash near-dedup at a similarity: every pair of word-shingle sets of Jaccard similarity 4/5 or more is linked.

Candidates come from the bit-sliced comparison of 64-bit fingerprints, and an exact comparison of whole sets follows. No radius
finds all pairs of that similarity, so the pairs beyond it are found exactly: sets of that similarity share a shingle among the
first n - ceil(4n/5) + 1 of either in any one order of all shingles, so those prefixes are joined. The order puts shingles that
are frequent in a bounded sample last; it decides the cost, not the result. Sets that share a shingle are first held against one
of them, for as long as that joins many, and then only pairs of different components are listed, each where it may first share
a shingle: if what follows there leaves room for 4/5, if the shingles just before are not shared, and if parity bits of the whole
sets differ in no more places than sets of that similarity can. None of these tests loses a pair, and whole sets are compared after.
A set's first listings are of few pairs: what they join need not be paired again, and the last listing has all the rest.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervane.llm.common import docs_of, releasing_task, save, shuffles_removed, slices, small_batches
from intervane.llm.components import components, contract, first_rows, nearest_roots
from intervane.llm.simhash_dedup import BITS, links

WORDS, SEED = 5, 42
#: Documents in the sample that finds frequent shingles, the least number of them that makes one frequent, and how many are kept.
SAMPLE, FREQUENT, MOST = 4000, 4, 200_000
#: Rows of set ids that may be broadcast to thin out the texts to compare; beyond it they are joined.
BROADCAST_ROWS = 400_000
#: Rounds against leads end once no more pairs than this many a row are left to list, or a round leaves more than this part of them.
#: All that are left are listed.
PAIRS_A_ROW, LITTLE_LESS = 2, 2 / 3
#: Pairs that a set may have at one shingle in the first listings, after each of which sets that were joined no longer pair. A last
#: listing has all that these left out. Else a large group of sets that are about 4/5 alike would be listed and compared as its square.
FEW = (2, 16)
#: Rounds of contraction between them. What they leave apart is only compared once more.
CONTRACTIONS = 2
#: Bits in which the fingerprints of candidates may differ.
RADIUS = 3
_PIECE = 50_000
#: The most parity bits that whole sets are first compared by. Larger sets have fewer for a shingle.
_MOST_BITS = 1 << 20
#: Columns of the parity bits of a set, 64 in each.
_BITS = ("b0", "b1", "b2", "b3")

_OF = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("set_id", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("prefix", pa.binary())]
    + [(b, pa.int64()) for b in _BITS]
)


def shingles(text: str, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Distinct XXH64 of the word shingles (A-Z lowered, ASCII white space), ascending; a shorter text is one shingle."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, dtype=np.uint64)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), seed)], dtype=np.uint64)
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(s, seed) for s in map(b" ".join, zip(*(w[k:] for k in range(words))))])
    return np.unique(np.frombuffer(raw, dtype=">u8").astype(np.uint64))


def set_id(s: np.ndarray) -> int:
    x = xxhash.xxh64_intdigest(s.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def fingerprint(s: np.ndarray) -> int:
    """SimHash of a shingle set: majority bits of its hashes; none: zero."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(s), 8192):
        ones += np.unpackbits(s[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(s)).view(">i8")[0])


def parity(s: np.ndarray) -> np.ndarray:
    """For each of 256 residues, one bit: whether an odd number of shingles has it. Two sets' bits differ in at most as many places as the sets."""
    counts = np.bincount((s & np.uint64(64 * len(_BITS) - 1)).astype(np.int64), minlength=64 * len(_BITS))
    return np.packbits(counts & 1).view(np.int64)


def prefix(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(4n/5) + 1 shingles of s: by hash, and after those the frequent ones by rank."""
    if not len(s):
        return s
    p = len(s) + 4 * len(s) // -5 + 1
    if not len(frequent):
        return s[:p]
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    hit = frequent[at] == s
    rare = s[~hit]
    if len(rare) >= p:
        return rare[:p]
    return np.concatenate([rare, s[hit][np.argsort(rank[at[hit]], kind="stable")][: p - len(rare)]])


def _texts(docs: DataFrame) -> DataFrame:
    return docs_of(docs).withColumn("text_hash", F.xxhash64("text"))


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles ascending, rank of each by frequency): at most MOST of those that FREQUENT or more of about SAMPLE texts hold."""
    texts = _texts(docs)
    one_in = max(1, texts.count() // SAMPLE)

    def run(batches):
        for batch in batches:
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text).view(np.int64))], names=["h"])

    part = texts.where(F.pmod("text_hash", F.lit(one_in)) == 0).groupBy("text_hash").agg(F.min("text").alias("text"))
    found = part.select("text").mapInArrow(releasing_task(run), "h long").groupBy("h").count().where(F.col("count") >= FREQUENT)
    hashes = found.orderBy(F.desc("count"), "h").select("h").limit(MOST).toArrow()["h"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], (len(hashes) - np.arange(len(hashes)))[order]


def sets_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, set_id, fp, n, prefix, b0 to b3) for every row: of its shingle set the SimHash, the size, the bytes of its first shingles, and parity bits."""
    frequent, rank = frequent_shingles(docs)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t) for t in part.column("text").to_pylist()]
                columns = [
                    part.column("doc_id"),
                    part.column("text_hash"),
                    pa.array([set_id(s) for s in sets], pa.int64()),
                    pa.array([fingerprint(s) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([prefix(s, frequent, rank).tobytes() for s in sets], pa.binary()),
                    *map(pa.array, np.array([parity(s) for s in sets], dtype=np.int64).reshape(-1, len(_BITS)).T),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_OF)

    return _texts(docs).mapInArrow(releasing_task(run), "doc_id long, text_hash long, set_id long, fp long, n int, prefix binary, " + ", ".join(f"{b} long" for b in _BITS))


def by_fingerprint(of: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): candidates among the sets of (set_id, fp): one set of each fingerprint with the others of it, and with one of each linked fingerprint."""
    sets = save(of.select("set_id", "fp").distinct(), "set-fingerprints")
    lead = save(sets.groupBy("fp").agg(F.min("set_id").alias("lead"), F.count("*").alias("n")), "fingerprint-leads")
    same = sets.join(lead.where("n > 1"), "fp").where("set_id <> lead").select(F.col("lead").alias("u"), F.col("set_id").alias("v"))
    of_u, of_v = (lead.select(F.col("fp").alias(f"{k}fp"), F.col("lead").alias(k)) for k in ("u", "v"))
    pairs = links(sets, radius).toDF("ufp", "vfp").join(of_u, "ufp").join(of_v, "vfp").select("u", "v")
    return pairs.union(same).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _groups(batches, names: tuple[str, ...]):
    """Columns of whole groups of equal h, from batches in the order of h."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if not len(now[0]):
            continue
        end = int(np.searchsorted(now[0], now[0][-1]))
        if end or (held and held[-1][0][-1] != now[0][0]):
            yield [np.concatenate(x) for x in zip(*held, [x[:end] for x in now])]
            held, now = [], [x[end:] for x in now]
        held.append(now)
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def shared_prefixes(of: DataFrame) -> DataFrame:
    """(h, n, set_id, at, before): sets by shingle h of their prefixes, its place there and the shingle before it, for each h that two sets or more share."""
    names = ("h", "n", "set_id", "at", "before")
    schema = "h long, n int, set_id long, at int, before long"

    def each(batches):
        for batch in batches:
            for part in slices(batch):
                prefixes = [np.frombuffer(x, dtype=np.int64) for x in part.column("prefix").to_pylist()]
                times = np.array([len(x) for x in prefixes], dtype=np.int64)
                h = np.concatenate(prefixes) if prefixes else np.empty(0, dtype=np.int64)
                at = np.arange(len(h)) - np.repeat(np.cumsum(times) - times, times)
                n, s = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), times) for c in ("n", "set_id"))
                before = np.r_[0, h[:-1]][: len(h)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, n, s, at.astype(np.int32), before)], names=list(names))

    def run(batches):
        for h, n, s, at, before in _groups(batches, names):
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
            h, n, s, at, before = (x[new] for x in (h, n, s, at, before))
            follows = np.zeros(len(h), dtype=bool)
            follows[1:] = h[1:] == h[:-1]
            many = follows.copy()
            many[:-1] |= follows[1:]
            yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (h, n, s, at, before)], names=list(names))

    rows = of.select("n", "set_id", "prefix").mapInArrow(releasing_task(each), schema)
    rows = rows.repartition("h").sortWithinPartitions("h", "n", "set_id")
    return rows.mapInArrow(releasing_task(run), schema)


def _mixed(h: np.ndarray, root: np.ndarray):
    """(from, to) of the groups of equal h with more than one root."""
    edges = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True])
    differs = np.add.reduceat(np.r_[0, (h[1:] == h[:-1]) & (root[1:] != root[:-1])], edges[:-1])
    return zip(edges[:-1][differs > 0].tolist(), edges[1:][differs > 0].tolist())


def against_leads(rows: DataFrame, turn: int) -> DataFrame:
    """(u, v, un, vn): for each h, sets v of other roots with one set u of the root that is most frequent there. rows: (h, n, set_id, root).

    turn: which set is u changes with it.
    """

    def run(batches):
        for h, n, s, root in _groups(batches, ("h", "n", "set_id", "root")):
            out = []
            for a, b in _mixed(h, root):
                roots, times = np.unique(root[a:b], return_counts=True)
                most = root[a:b] == roots[np.argmax(times)]
                v = a + np.flatnonzero(~most)
                out.append((np.full(len(v), a + np.argmax(most)), v))
            if out:
                yield _pairs(out, s, n)

    rows = rows.repartition("h").withColumn("at", F.xxhash64("set_id", F.lit(turn))).sortWithinPartitions("h", "at")
    return rows.select("h", "n", "set_id", "root").mapInArrow(releasing_task(run), "u long, v long, un int, vn int")


def across(rows: DataFrame, of: DataFrame, most: int | None = None) -> DataFrame:
    """(u, v): sets of different roots that share an h and may be 4/5 alike, a pair of that similarity once at least. rows: (h, n, set_id, at, before, root).

    Take the first shingle in order that two sets share, at places i and j. Those before it are not shared, so at most
    min(un - i, vn - j) are, and 4/5 needs 4/9 of un + vn. Where that fails, or the two shingles before are one, h is not the
    first or the pair is not alike; and alike sets differ in at most a ninth of un + vn, so their parity bits do.

    most: of the pairs of a set with smaller ones at one h, only so many, those of least set_id; sets of which pairs were left out
    come as (v, v) too.
    """
    names = ("h", "n", "set_id", "root", "at", "before", *_BITS)

    def run(batches):
        for h, n, s, root, at, before, *bits in _groups(batches, names):
            n, bits = n.astype(np.int64), np.stack(bits, axis=1).view(np.uint64)
            rest = n - at
            out, held = [], 0
            for a, b in _mixed(h, root):
                first = a + np.searchsorted(n[a:b], -(-4 * n[a:b] // 5))
                for i in range(a + 1, b):
                    j = np.arange(first[i - a], i)
                    both = n[j] + n[i]
                    may_be_first = (before[j] != before[i]) | (at[j] == 0) | (at[i] == 0)
                    j = j[(root[j] != root[i]) & (9 * np.minimum(rest[j], rest[i]) >= 4 * both) & may_be_first]
                    j = j[9 * np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64) <= n[j] + n[i]]
                    if most is not None and len(j) > most:
                        j = np.append(j[np.argsort(s[j], kind="stable")[:most]], i)
                    if len(j):
                        out.append((j, np.full(len(j), i)))
                        held += len(j)
                    if held > _PIECE:
                        yield _pairs(out, s, n)
                        out, held = [], 0
            if out:
                yield _pairs(out, s, n)

    rows = rows.join(of.select("set_id", *_BITS).dropDuplicates(["set_id"]), "set_id").select(*names)
    return rows.repartition("h").sortWithinPartitions("h", "n", "set_id").mapInArrow(releasing_task(run), "u long, v long, un int, vn int").select("u", "v").distinct()


def _pairs(at: list[tuple[np.ndarray, np.ndarray]], s: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    i, j = (np.concatenate(x) for x in zip(*at))
    return pa.RecordBatch.from_arrays([pa.array(s[i]), pa.array(s[j]), pa.array(n[i].astype(np.int32)), pa.array(n[j].astype(np.int32))], names=["u", "v", "un", "vn"])


def possible(pairs: DataFrame) -> DataFrame:
    """(u, v) of the pairs whose prefixes overlap enough: a row is one shared shingle of (u, v, un, vn).

    Beyond its shared prefix, a pair can share no more than what follows the prefix that ends first.
    """
    n = pairs.groupBy("u", "v").agg(F.count("*").alias("shared"), F.first("un").alias("un"), F.first("vn").alias("vn"))
    rest = F.ceil(4 * F.greatest("un", "vn") / 5) - 1
    n = n.where(5 * F.least("un", "vn") >= 4 * F.greatest("un", "vn"))
    return n.where(9 * (F.col("shared") + rest) >= 4 * (F.col("un") + F.col("vn"))).select("u", "v")


def wide_parity(s: np.ndarray) -> bytes:
    """The size of s, and parity bits as in parity(), at least two for each shingle up to _MOST_BITS: a power of two of residues."""
    bits = min(max(64, 1 << (2 * len(s)).bit_length()), _MOST_BITS)
    counts = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.int64(len(s)).tobytes() + np.packbits(counts & 1).tobytes()


def _may_be_near(a: pa.BinaryScalar, b: pa.BinaryScalar) -> bool:
    """Whether sets of wide_parity() a and b can be 4/5 alike: such sets differ in at most a ninth of both sizes, and so do their bits."""
    x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (a, b))
    n, m = int(x[0]), int(y[0])
    least = min(len(x), len(y)) - 1
    x, y = (np.bitwise_xor.reduce(z[1:].reshape(-1, least), axis=0) for z in (x, y))
    return 9 * int(np.bitwise_count(x ^ y).sum()) <= n + m


def _is_near(a: pa.BinaryScalar, b: pa.BinaryScalar) -> bool:
    x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (a, b))
    both_in = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both_in >= 4 * (len(x) + len(y) - both_in)


def _compared(docs: DataFrame, of: DataFrame, pairs: DataFrame, form, test, name: str) -> DataFrame:
    """Those of pairs (u, v) for which test holds of the forms (bytes) of both shingle sets. pairs is read several times."""
    ids = save(pairs.select(F.col("u").alias("set_id")).union(pairs.select("v")).distinct(), "compared-sets")
    some = F.broadcast if ids.count() <= BROADCAST_ROWS else (lambda d: d)
    texts = of.join(some(ids), "set_id", "left_semi").groupBy("set_id").agg(F.min("text_hash").alias("text_hash")).select("text_hash")
    texts = _texts(docs).join(some(texts), "text_hash", "left_semi").groupBy("text_hash").agg(F.min("text").alias("text"))

    def forms(batches):
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([form(s) for s in sets], pa.binary())], names=["set_id", "s"])

    sets = save(texts.select("text").mapInArrow(releasing_task(forms), "set_id long, s binary"), name)
    some = F.broadcast if pairs.count() <= BROADCAST_ROWS else (lambda d: d)
    both = sets.select(F.col("set_id").alias("u"), F.col("s").alias("a")).join(some(pairs), "u").join(sets.select(F.col("set_id").alias("v"), F.col("s").alias("b")), "v")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                ok = [test(a, b) for a, b in zip(part.column("a"), part.column("b"))]
                yield part.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(releasing_task(run), "u long, v long")


def confirmed(docs: DataFrame, of: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (u, v) whose whole shingle sets have a Jaccard similarity of 4/5 or more.

    A set goes to each of its pairs, so pairs are first held against parity bits as wide as the sets, a few bits for the eight
    bytes of a shingle. They lose no pair, and whole sets go only to what they leave.
    """
    left = save(_compared(docs, of, pairs, wide_parity, _may_be_near, "set-parities"), "pairs-by-parity")
    return _compared(docs, of, left, np.ndarray.tobytes, _is_near, "shingle-sets")


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, root) for every row of docs: rows of one root reach each other over pairs of similarity 4/5 or more.

    Equal sets are one; texts without words are one component. A set's id is a 64-bit hash, as is a shingle.
    """
    of = save(sets_of(docs), "shingle-prefixes")
    shared = save(shared_prefixes(of), "shared-prefixes")
    rows = shared.count()
    edges = contract(save(confirmed(docs, of, save(by_fingerprint(of), "pairs-by-fingerprint")), "near-fingerprints"), CONTRACTIONS)
    rooted, before = save(_with_roots(shared, nearest_roots(edges)), "rooted"), None
    for turn in count():
        left = _left(rooted)
        if left <= PAIRS_A_ROW * rows or (before is not None and left > LITTLE_LESS * before):
            break
        before = left
        new = save(confirmed(docs, of, save(possible(against_leads(rooted, turn)), "pairs-with-leads")), "near-leads")
        edges = contract(edges.union(new), CONTRACTIONS)
        rooted = save(_with_roots(shared, nearest_roots(edges)), "rooted")
    for most in (*FEW, None):
        listed = save(across(rooted, of, most), "pairs-across")
        new, cut = confirmed(docs, of, listed.where("u <> v")), listed.where("u = v").select(F.col("u").alias("set_id"))
        if most is None or cut.isEmpty():
            break
        edges = contract(edges.union(save(new, "near-across")), 2 * CONTRACTIONS)
        shared = shared.join(shared.join(cut, "set_id", "left_semi").select("h").distinct(), "h", "left_semi")
        rooted = save(_with_roots(shared, nearest_roots(edges)), "rooted")
    return _with_roots(of.select("doc_id", "text_hash", "set_id"), components(edges.union(new))).drop("set_id")


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))


def _left(rooted: DataFrame) -> int:
    """At most so many pairs of different roots share an h, one for each h they share."""
    of_root = rooted.groupBy("h", "root").agg(F.count("*").alias("n"))
    of_h = of_root.groupBy("h").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return int(of_h.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()[0] or 0)


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with exactly one row of each component: that of the smallest doc_id, nulls last."""
    with shuffles_removed(docs.sparkSession), small_batches(docs.sparkSession):
        found = save(members(docs), "near-copies")
    return first_rows(docs, found)
