"""Exchange of sorted key blocks between chunks of documents and hash buckets, with answers on the way back.

A chunk sends what it has to say about its keys in blocks, one for each bucket it has keys for. With one bucket for each chunk and
a direct exchange the blocks would grow with the square of the corpus and shrink to nothing. So no sender splits its keys more
than ``fan`` ways: beyond ``fan`` chunks, groups of ``fan`` senders are combined within a coarse bucket, and the combined entries,
each once, are split again, level by level, until a bucket is as small as a chunk. A corpus of n chunks takes
log(n) / log(fan) levels and n * fan blocks a level. Answers come down the same levels: each combined block is answered first,
and then the blocks that went into it.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervane.llm.common import docs_of, releasing, releasing_pair, slices

BLOCKS = "bucket long, sender long, n long, keys binary, extra binary"
ANSWERS = "sender long, bucket long, n long, marks binary"
_BLOCKS = pa.schema([("bucket", pa.int64()), ("sender", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("extra", pa.binary())])
_ANSWERS = pa.schema([("sender", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("marks", pa.binary())])
#: A sender splits its keys no more than so many ways.
MOST = 256
_SQUEEZE, _OPEN = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


@dataclass(frozen=True)
class Fan:
    """Chunks of a corpus, ways that a sender splits its keys, levels of buckets, and shuffle partitions of each exchange."""

    chunks: int
    fan: int
    levels: int
    partitions: int

    @staticmethod
    def of(docs: DataFrame, n_bytes: int, chunk_bytes: int, most: int = MOST) -> Fan:
        chunks = max(1, -(-n_bytes // chunk_bytes))
        levels = 1
        while most**levels < chunks:
            levels += 1
        fan = 1
        while fan**levels < chunks:
            fan += 1
        return Fan(chunks, fan, levels, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * chunks))

    def cuts(self, level: int, bucket: int = 0) -> np.ndarray:
        """Inner bounds of the 64-bit keys of the buckets that a bucket of the level above (at level 0: all keys) is split into."""
        parts = self.fan ** (level + 1)
        return np.array([((bucket * self.fan + k) << 64) // parts for k in range(1, self.fan)], dtype=np.uint64)


def _squeeze(batches):
    for batch in batches:
        for part in slices(batch):
            z = [_SQUEEZE.compress(t.encode("utf-8", "surrogatepass")) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(z, pa.binary()), part.column("chunk")], names=["doc_id", "z", "chunk"])


def deal(docs: DataFrame, fan: Fan) -> DataFrame:
    """(doc_id, z, chunk): whole texts, compressed for the way, dealt out to the chunks by a hash of id and text."""

    d = docs_of(docs).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(fan.chunks)))
    return d.mapInArrow(_squeeze, "doc_id long, z binary, chunk long").repartition(fan.partitions, "chunk")


def texts(table: pa.Table) -> list[bytes]:
    return [_OPEN.decompress(z) for z in table["z"].to_pylist()]


def small(n: np.ndarray) -> bytes:
    """Numbers as bytes, those from 255 on after them in full; most are alike, so they are compressed."""
    return _SQUEEZE.compress(np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype(np.int64).tobytes())


def unsmall(raw: bytes, size: int) -> np.ndarray:
    raw = _OPEN.decompress(raw)
    out = np.frombuffer(raw, np.uint8, size).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, np.int64, offset=size)
    return out


def front(keys: np.ndarray, bits: int = 64) -> bytes:
    """Sorted keys, of which the high bits count, as differences: four low bytes each, which are noise, then the high bytes, which are small and compressed."""
    d = np.diff(keys >> np.uint64(64 - bits), prepend=np.uint64(0)).astype("<u8")
    parts = d[1:].view(np.uint8).reshape(-1, 8)
    high = _SQUEEZE.compress(np.ascontiguousarray(parts[:, 4:].T).tobytes())
    return len(parts).to_bytes(8, "little") + d[:1].tobytes() + np.ascontiguousarray(parts[:, :4]).tobytes() + high


def unfront(raw: bytes, bits: int = 64) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    d = np.zeros((n + 1, 8), np.uint8)
    d[0] = np.frombuffer(raw, np.uint8, 8, 8)
    d[1:, :4] = np.frombuffer(raw, np.uint8, 4 * n, 16).reshape(n, 4)
    d[1:, 4:] = np.frombuffer(_OPEN.decompress(raw[16 + 4 * n :]), np.uint8).reshape(4, n).T
    return np.cumsum(d.view("<u8").ravel(), dtype=np.uint64) << np.uint64(64 - bits)


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def key_blocks(sender: int, first_bucket: int, keys: np.ndarray, extra: np.ndarray, cuts: np.ndarray, bits: int = 64) -> pa.Table:
    """Blocks of sorted keys and a number for each, split at the cuts."""
    at = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
    return table_of([(first_bucket + b, sender, z - a, front(keys[a:z], bits), small(extra[a:z])) for b, (a, z) in enumerate(zip(at, at[1:])) if z > a], _BLOCKS)


def blocks_table(rows: list[tuple]) -> pa.Table:
    return table_of(rows, _BLOCKS)


def marks_of(answers: pa.Table) -> list[tuple[int, bytes]]:
    """(entries, marks) of the answers to one sender, in the order of its buckets."""
    return [(n, m) for _, n, m in sorted(zip(*(answers[c].to_pylist() for c in ("bucket", "n", "marks"))))]


class Entries(Protocol):
    """How an operator combines the blocks of one bucket and answers them."""

    def combine(self, table: pa.Table, cuts: np.ndarray | None) -> Any:
        """The distinct entries of the blocks, in the order of the buckets that the cuts make, and where each went."""

    def send(self, state: Any, sender: int, first_bucket: int, cuts: np.ndarray) -> pa.Table:
        """Blocks of the combined entries."""

    def settle(self, state: Any) -> Any:
        """Answers to the combined entries, when all blocks of their bucket are in them."""

    def read(self, marks: list[tuple[int, bytes]]) -> Any:
        """Answers to the combined entries from those to their blocks."""

    def give(self, state: Any, answers: Any) -> list[bytes]:
        """Answers to each of the blocks that were combined."""


def answered(blocks: DataFrame, fan: Fan, how: Entries, level: int = 0) -> DataFrame:
    """(sender, bucket, n, marks): the answer to each of the blocks (BLOCKS), which come from fewer than fan ** (levels - level) senders a bucket."""

    def rows(table: pa.Table, marks: list[bytes]) -> pa.Table:
        return pa.table([table["sender"], table["bucket"], table["n"], pa.array(marks, pa.binary())], schema=_ANSWERS)

    def settle(table: pa.Table) -> pa.Table:
        state = how.combine(table, None)
        return rows(table, how.give(state, how.settle(state)))

    if level == fan.levels - 1:
        return blocks.repartition(fan.partitions, "bucket").groupBy("bucket").applyInArrow(releasing(settle), ANSWERS)

    def place(table: pa.Table) -> tuple[int, int, np.ndarray]:
        bucket, group = (table[c][0].as_py() for c in ("bucket", "crowd"))
        return bucket, group, fan.cuts(level + 1, bucket)

    def up(table: pa.Table) -> pa.Table:
        bucket, group, cuts = place(table)
        return how.send(how.combine(table, cuts), group, bucket * fan.fan, cuts)

    def down(table: pa.Table, answers: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return _ANSWERS.empty_table()
        state = how.combine(table, place(table)[2])
        return rows(table, how.give(state, how.read(marks_of(answers))))

    dealt = blocks.withColumn("crowd", F.expr(f"sender div {fan.fan}")).repartition(fan.partitions, "bucket", "crowd")
    sent = dealt.groupBy("bucket", "crowd").applyInArrow(releasing(up), BLOCKS)
    got = answered(sent, fan, how, level + 1).select(F.expr(f"bucket div {fan.fan}").alias("above"), F.col("sender").alias("crowd"), "bucket", "n", "marks")
    got = got.repartition(fan.partitions, "above", "crowd")
    return dealt.groupBy("bucket", "crowd").cogroup(got.groupBy("above", "crowd")).applyInArrow(releasing_pair(down), ANSWERS)
