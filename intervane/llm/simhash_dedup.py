"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints within the radius agree in all of some m-r of m blocks of bits, so every pair of that kind meets in one of
C(m, r) tables whose key is those blocks. Within a cell of a table the other bits are stored as planes: one long integer for
each bit, with a place for each fingerprint. A fingerprint is compared with all others of its cell at once: carry-save
counters of two bits and an overflow run over the planes, and the cell is left as soon as every distance exceeds the radius.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervane.llm.common import docs_of, save, slices
from intervane.llm.components import components, first_rows

BITS, CELL = 64, 4096
#: Rows of all tables that a task compares on average; small, as comparing costs far more than reading them.
_ROWS_A_TASK = 20_000


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of each word shingle (A-Z lowered, ASCII white space); no words: zero."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(s, seed) for s in map(b" ".join, zip(*(w[k:] for k in range(words))))])
    n, ones = len(raw) // 8, np.zeros(BITS, dtype=np.int64)
    rows = np.frombuffer(raw, dtype=np.uint8).reshape(n, 8)
    for at in range(0, n, 8192):
        ones += np.unpackbits(rows[at : at + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long): fp holds the 64 bits as a signed number."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                fps = np.array([fingerprint(t, words, seed) for t in part.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs_of(docs).mapInArrow(run, "doc_id long, fp long")


def groups_within(fps: list[int], planes_of: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (fp, the query that reached it) of a cell, within the radius: they join what reaches each other in steps of at most radius.

    planes_of: bits in which the cell's fingerprints may differ. Each fingerprint is a query once, against those not yet
    reached; a link is given once for each fingerprint reached.
    """
    n = len(fps)
    cols = np.array(fps, dtype=np.uint64)
    planes = [int.from_bytes(np.packbits(((cols >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes(), "little") for b in planes_of]
    left, out = (1 << n) - 1, []
    while left:
        first = (left & -left).bit_length() - 1
        left &= left - 1
        front = [first]
        while front and left:
            q = front.pop()
            near = _within(planes, planes_of, fps[q], left, radius)
            left &= ~near
            while near:
                low = near & -near
                k = low.bit_length() - 1
                near ^= low
                front.append(k)
                out.append((fps[k], fps[q]))
    return out


def _within(planes: list[int], planes_of: list[int], query: int, live: int, radius: int) -> int:
    """Places of live whose distance from query is at most radius; carry-save counters hold the distances' bits."""
    counters = [0] * radius.bit_length()
    for plane, b in zip(planes, planes_of):
        carry = (live & ~plane) if query >> b & 1 else (live & plane)
        for k, c in enumerate(counters):
            counters[k], carry = c ^ carry, c & carry
            if not carry:
                break
        if carry:
            live &= ~carry
            if not live:
                return 0
            counters = [c & live for c in counters]
    full = (1 << len(counters)) - 1
    for over in range(radius + 1, full + 1):
        hit = live
        for k, c in enumerate(counters):
            hit &= c if over >> k & 1 else ~c
        live &= ~hit
    return live


def _tables(n: int, radius: int, bits: int = BITS) -> list[tuple[int, list[int]]]:
    """(key mask, other bits) of each table: the fewest blocks for which an even spread would leave cells of no more than 64 fingerprints.

    More blocks mean longer keys and more tables; every choice finds all pairs.
    """
    m = radius + 1
    while m < radius + 5 and n / 2 ** (bits * (m - radius) // m) > 64:
        m += 1
    edges = [bits * k // m for k in range(m + 1)]
    blocks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(m)]
    out = []
    for free in combinations(range(m), radius):
        mask = sum(blocks[k] for k in range(m) if k not in free)
        out.append((mask, [b for b in range(bits) if not mask >> b & 1]))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = 3, cell: int = CELL) -> DataFrame:
    """Links (u, v), within radius of each other, that join all distinct fingerprints (fp long) of fps that do so, transitively.

    A key with more than cell fingerprints is dealt out to blocks, and each two blocks of it meet in a task of their own, so
    that no task holds more than two blocks and no pair is missed.
    """
    distinct = save(fps.select("fp").distinct(), "fingerprints")
    n = distinct.count()
    masks = _tables(n, radius)
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key")) for t, (mask, _) in enumerate(masks)])).alias("k")).select("fp", "k.t", "k.key")
    hot = keyed.groupBy("t", "key").count().where(F.col("count") > cell).select("t", "key", F.ceil(F.col("count") / cell).cast("int").alias("blocks"))
    dealt = keyed.join(save(hot, "hot-cells"), ["t", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(other, "own").alias("i"), F.greatest(other, "own").alias("j")))
    cells = dealt.withColumn("own", own).select("fp", "t", "key", F.explode(meets).alias("at")).select("fp", "t", "key", "at.i", "at.j")
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * len(masks) // _ROWS_A_TASK))
    cells = cells.repartition(tasks, "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "fp")
    others = [planes for _, planes in masks]

    def run(batches):
        at, held = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for fp, *key in zip(*(batch.column(c).to_pylist() for c in ("fp", "t", "key", "i", "j"))):
                if key != at:
                    if len(held) > 1:
                        out += groups_within(held, others[at[0]], radius)
                    at, held = key, []
                held.append(fp & (1 << 64) - 1)
            yield _edges(out)
        if len(held) > 1:
            yield _edges(groups_within(held, others[at[0]], radius))

    return cells.mapInArrow(run, "u long, v long").distinct()


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["u", "v"])


def cluster(docs: DataFrame, radius: int = 3, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id: smallest doc_id reachable over links of at most radius differing bits, itself included. Null and empty
    texts have fingerprint zero and link like any other. Rows without doc_id take part and get their component's id, which is
    null only if no row of the component has one.
    """
    of = save(fingerprints(docs, words, seed), "document-fingerprints")
    least = of.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(of, radius))
    linked = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = save(linked, "linked")
    of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return of.join(linked.join(of_root, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = 3, words: int = 3, seed: int = 42) -> DataFrame:
    """docs with exactly one row of each component: that of the smallest doc_id, nulls last.

    Components are told apart by their root fingerprint, so equal or null doc_ids in different components each keep a row.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                fps = np.array([fingerprint(t, words, seed) for t in part.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(fps)], names=["doc_id", "text_hash", "fp"])

    hashed = docs_of(docs).withColumn("text_hash", F.xxhash64("text"))
    of = save(hashed.mapInArrow(run, "doc_id long, text_hash long, fp long"), "document-fingerprints")
    roots = components(links(of, radius))
    members = of.join(roots, of.fp == roots.node, "left").select("doc_id", "text_hash", F.coalesce("root", "fp").alias("root"))
    return first_rows(docs, members)
