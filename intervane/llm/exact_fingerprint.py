"""Canonical exact digests: Unicode normalisation, case and white-space folding, 128-bit xxhash, and byte comparison of what
shares a digest."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervane.llm.common import docs_of, from_rows, save, slices

#: Rows of digests that may be broadcast (16 MB at most); beyond it only those of large classes are, and the others are joined.
BROADCAST_ROWS = 200_000
#: Rows of a class that may meet in one task without more ado.
HOT = 512
_ROWS_A_SALT = 64
#: Bytes of text in a block of documents in doc_id order, which a task streams through.
_BLOCK_BYTES = 256 << 20
#: So many blocks at most are asked of one quantile function; a task streams, so larger blocks need no more memory.
_BLOCKS = 20_000
_NULL_ID = -(1 << 63)


def canonical(text: str) -> str:
    """NFKC, case folded, NFKC again, and runs of white space as one space, none at the ends."""
    if text.isascii():
        return " ".join(text.lower().split())
    t = (text if is_normalized("NFKC", text) else normalize("NFKC", text)).casefold()
    return " ".join((t if is_normalized("NFKC", t) else normalize("NFKC", t)).split())


def digest(canon: str, bits: int = 128) -> str:
    """The first bits (a multiple of 4) of the 128-bit xxhash."""
    return xxhash.xxh3_128_hexdigest(canon.encode("utf-8", "surrogatepass"))[: bits // 4]


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as many first code points of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_PAIRS = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("h", pa.binary()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("digest", pa.string()), ("edited_digest", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_PACKED = pa.schema([("block", pa.int32()), ("peek", pa.int32()), ("k", pa.int64()), ("h", pa.binary()), ("has_id", pa.bool_()), ("z", pa.binary())])


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def with_next(docs: DataFrame, blocks: int | None = None, bits: int = 128) -> DataFrame:
    """Each row with the digest of its text, of its edited text, and the likeness (1 if the canonical bytes are equal, else 0) to the edited and the next text.

    The next document by ascending doc_id (null ids first, equal ids by a hash of the text; after the last comes the first) is
    found without one global sort: rows go to blocks of doc_id between approximate quantiles, and each block also gets a copy
    of the first row of the next. Only quantiles and first ids, a few for each block, come to the driver; texts travel
    compressed. blocks: by default one for each 256 MB of text, four for each shuffle partition at least.
    """
    d = docs_of(docs).withColumn("k", F.coalesce("doc_id", F.lit(_NULL_ID)))
    if blocks is None:
        size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        blocks = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(_BLOCKS, -(-size // _BLOCK_BYTES)))
    quantiles = F.percentile_approx("k", [i / blocks for i in range(1, blocks)], max(10_000, 4 * blocks)) if blocks > 1 else F.lit(None)
    cuts = sorted(set(d.select(quantiles).first()[0] or []))
    first = d.select("k").mapInArrow(lambda batches: _first_of_block(batches, cuts), "block int, k long").groupBy("block").agg(F.min("k").alias("k"))
    heads = sorted((r.k, r.block) for r in first.collect())
    peeks = {k: heads[i - 1][1] for i, (k, _) in enumerate(heads)}  # the first row of a block, seen from the block before

    def packed(batches):
        squeeze = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        for batch in batches:
            for part in slices(batch):
                rows = []
                for name, text, k in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "k"))):
                    b, at = _raw(text), bisect_left(cuts, k)
                    row = (k, xxhash.xxh3_128_digest(b), name is not None, squeeze(b))
                    rows.append((at, 0, *row))
                    if k in peeks:
                        rows.append((peeks[k], 1, *row))
                yield from_rows(rows, _PACKED)

    sent = d.mapInArrow(packed, "block int, peek int, k long, h binary, has_id boolean, z binary")
    sent = sent.repartition(F.col("block")).sortWithinPartitions("block", "peek", "k", "h")

    def pairs(batches):
        open_ = zstandard.ZstdDecompressor().decompress
        last = None
        for batch in batches:
            rows = []
            for at, peek, k, h, has_id, z in zip(*(batch.column(c).to_pylist() for c in _PACKED.names)):
                text = open_(z).decode("utf-8", "surrogatepass")
                now = (at, k, h, has_id, text, canonical(text))
                if last and last[0] == at:
                    rows.append(_pair(last, now, bits))
                last = None if peek else now
            yield from_rows(rows, _PAIRS)

    return sent.mapInArrow(pairs, "doc_id long, k long, h binary, n_chars long, edited_sha256 string, digest string, edited_digest string, near_edited double, near_next double")


def _first_of_block(batches, cuts: list[int]):
    """(block, its smallest k here) over batches of k; a k belongs to the block after the cuts below it."""
    least: dict[int, int] = {}
    for batch in batches:
        k = np.sort(batch.column("k").to_numpy(zero_copy_only=False))
        if len(k):
            at = np.searchsorted(np.array(cuts, dtype=np.int64), k, side="left")
            new = np.concatenate([[True], at[1:] != at[:-1]])
            for b, x in zip(at[new].tolist(), k[new].tolist()):
                least[b] = min(x, least.get(b, x))
    yield from_rows(list(least.items()), pa.schema([("block", pa.int32()), ("k", pa.int64())]))


def _pair(this: tuple, following: tuple, bits: int) -> tuple:
    _, k, h, has_id, text, canon = this
    new = edited(text, following[4])
    new_canon = canonical(new)
    return (k if has_id else None, k, h, len(text), hashlib.sha256(_raw(new)).hexdigest(), digest(canon, bits), digest(new_canon, bits), float(new_canon == canon), float(following[5] == canon))


def _hot(classes: DataFrame, size: str) -> DataFrame:
    """The classes of more than HOT rows; of more than that where there are too many of these to broadcast."""
    rows = classes.agg(F.sum(size)).first()[0] or 0
    return classes.where(F.col(size) > max(HOT, -(-rows // BROADCAST_ROWS)))


def join_classes(rows: DataFrame, classes: DataFrame, key: str, size: str, how: str = "left") -> DataFrame:
    """rows joined with classes (a row for each key, with the number of rows that have it); how: left or inner.

    Classes of many rows are at most BROADCAST_ROWS and are broadcast, so their rows stay where they are; the others are
    joined by key, of which no task gets more than HOT rows (or a two-hundred-thousandth of all) by one key.
    """
    if classes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(classes), key, how)
    hot = save(_hot(classes, size), "large-classes")
    cold = classes.join(F.broadcast(hot.select(key)), key, "left_anti")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return rest.unionByName(rows.join(F.broadcast(hot), key))


def strangers(docs: DataFrame, rows: DataFrame, bits: int = 128) -> DataFrame:
    """(k, h, fingerprint) of rows whose canonical bytes differ from those of the first row with the same digest.

    rows: (k, h, digest) of docs. Only texts whose digest occurs twice or more are sent; each is compared with the first of
    its digest. A digest of many rows is dealt out by a salt, with a copy of its first text for each.
    """
    shared = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("k", "h")).alias("first")).where("n > 1")
    shared = save(shared.withColumn("salts", F.ceil(F.col("n") / _ROWS_A_SALT).cast("int")), "shared-digests")

    def canon(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in slices(batch):
                out = []
                for text, k in zip(part.column("text").to_pylist(), part.column("k").to_pylist()):
                    c = canonical(text)
                    out.append((k, xxhash.xxh3_128_digest(_raw(text)), digest(c, bits), squeeze(_raw(c))))
                yield from_rows(out, pa.schema([("k", pa.int64()), ("h", pa.binary()), ("digest", pa.string()), ("z", pa.binary())]))

    texts = docs_of(docs).select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("k"), "text").mapInArrow(canon, "k long, h binary, digest string, z binary")
    member = join_classes(texts, shared, "digest", "n", "inner")
    member = member.withColumn("salt", F.pmod(F.xxhash64("k", "h"), F.col("salts")).cast("int"))
    is_first = (F.col("k") == F.col("first.k")) & (F.col("h") == F.col("first.h"))
    # The first row goes to every salt, marked; equal rows of it may too, which changes nothing.
    sent = member.select("k", "h", "digest", "z", F.explode(F.when(is_first, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array("salt"))).alias("salt"), is_first.alias("lead"))
    sent = sent.repartition("digest", "salt").sortWithinPartitions("digest", "salt", F.desc("lead"), "k", "h")

    def compare(batches):
        open_ = zstandard.ZstdDecompressor().decompress
        key, lead = None, b""
        for batch in batches:
            out = []
            for k, h, d, z, salt in zip(*(batch.column(c).to_pylist() for c in ("k", "h", "digest", "z", "salt"))):
                bytes_ = open_(z)
                if (d, salt) != key:
                    key, lead = (d, salt), bytes_
                elif bytes_ != lead:
                    out.append((k, h, f"{d}-{hashlib.sha256(bytes_).hexdigest()}"))
            yield from_rows(out, pa.schema([("k", pa.int64()), ("h", pa.binary()), ("fingerprint", pa.string())]))

    return sent.mapInArrow(compare, "k long, h binary, fingerprint string").distinct()


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id", "class_size"]


def fingerprint(docs: DataFrame, bits: int = 128, blocks: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id, class_size) for every row.

    fingerprint: the digest of the canonical text; where different canonical texts share a digest, those unlike its first also
    carry their SHA-256. edited_fingerprint: the digest of the edited text. class_id: smallest doc_id with this fingerprint
    (null if none has an id). Null texts are empty, rows without doc_id come first in order, repeated rows count each.
    """
    of = save(with_next(docs, blocks, bits), "digests")
    odd = strangers(docs, of.select("k", "h", "digest"), bits)
    of = of.join(odd, ["k", "h"], "left").withColumn("fingerprint", F.coalesce("fingerprint", "digest"))
    of = save(of.withColumnRenamed("edited_digest", "edited_fingerprint").select(*COLUMNS[:7]), "fingerprints")
    classes = of.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    out = join_classes(of, save(classes.where("class_size > 1"), "classes"), "fingerprint", "class_size")
    alone = F.col("class_size").isNull()
    return out.withColumns({"class_id": F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")), "class_size": F.coalesce("class_size", F.lit(1)).cast("long")}).select(*COLUMNS)
