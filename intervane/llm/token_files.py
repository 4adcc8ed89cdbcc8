"""Token-id files: a zstandard dictionary is shared by all documents, each of which is compressed on its own.

A file is a sequence of shards, in ascending doc_id order. A shard holds a head (magic, bytes an id, documents, SHA-256 of the
dictionary), an index (doc_ids, null flags, places of the frames, numbers of ids before each) and one zstandard frame a document.
So a short document is read by one look in the index and one small frame; without the dictionary its frame would hold too little
to compress. Shards are rows of a Parquet table in the shared folder, which Spark's writers commit, with their range of doc_id
beside them; the dictionary is a table of one row.

Order: doc_id, nulls first; rows of the same doc_id in the order of the input. Documents are dealt out by range, so that each
partition writes its shards in order; only the partitions' totals come to the driver. Null texts are empty ones and hold the end
id alone; repeated rows are documents each; other columns are left behind. An empty table gives no shards and no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervane.llm.common import docs_of, portions, release, save

VOCABULARY, END_ID = "byte_bpe_50k.json", 2
_MAGIC, _HEAD = b"IVTOKEN1", struct.Struct("<8sIQ32s")
#: Characters that the tokenizer's pattern takes for white space.
WHITE = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Where the pattern always cuts: before marks after a letter, and before a space between visible ASCII.
_LETTER_MARK = rf"([{_LETTERS}])([!-/:-@\[-`{{-~])"
_BEFORE_SPACE = re.compile(r"(?<=[!-~])(?= [!-~])")
_WORD = re.compile(rf"[{_LETTERS}]+").fullmatch
#: Stands at the head of a part that has no space before it.
_BARE = "\x00"
#: Texts with any of these are cut at fewer places: white space side by side, or other than spaces and line ends.
_ODD = rf"{_BARE}|  |\n\n|\n | \n|[{''.join(w for w in WHITE if w not in ' \n')}]"
#: Parts that a worker keeps, with the most characters of one, and words that are encoded at once.
_MOST_KEPT, _LONGEST_KEPT, _AT_ONCE = 1_200_000, 64, 256
_KNOWN: dict[str, tuple] = {}

SHARDS = "part int, shard int, first_id long, last_id long, n_docs long, n_before long, n_ids long, body binary"
_SHARDS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_before", pa.int64()), ("n_ids", pa.int64()), ("body", pa.binary())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


@dataclass(frozen=True)
class Files:
    """Bounds of the dictionary's training, which don't change what is read back, and sizes.

    dictionary_bytes: of the dictionary. sample: documents at most, and sample_bytes of their serialized ids, that it is trained on.
    shard_ids: ids after which a shard ends. partition_bytes: of text, of a partition, unless there were more than most_partitions.
    """

    vocabulary: str | None = None
    end_id: int = END_ID
    dictionary_bytes: int = 65_536
    sample: int = 2000
    sample_bytes: int = 6_000_000
    level: int = 3
    shard_ids: int = 1 << 20
    partition_bytes: int = 24_000_000
    most_partitions: int = 100_000


def tokenizer_path(name: str = VOCABULARY) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteIds:
    """Token ids of texts.

    The tokenizer's pattern cuts a text before it merges anything, so ids are found once for each part between cuts that hold
    whatever comes before and after, and kept from task to task. Words of letters are encoded many at a time, each up to the next
    id that begins with a space. Texts with white space side by side are cut at fewer places, and texts that name a special token
    not at all.
    """

    def __init__(self, path: str):
        if path not in _KNOWN:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer, models, pre_tokenizers

            of = Tokenizer.from_file(path)
            special = [t.content for t in of.get_added_tokens_decoder().values()]
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)["model"]
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["merges"]]
            # A space and the letters after it are one piece of the pattern, so for these the pattern need not run.
            plain = Tokenizer(models.BPE(vocab=spec["vocab"], merges=merges, cache_capacity=0))
            plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            firsts = np.zeros(max(spec["vocab"].values()) + 1, bool)
            firsts[[i for token, i in spec["vocab"].items() if token[0] == "\u0120"]] = True  # a space, as the vocabulary writes it
            _KNOWN[path] = (of, special, plain, firsts, {})
        self.of, self.special, self.plain, self.firsts, self.known = _KNOWN[path]

    def odd_parts(self, text: str) -> list[str]:
        """Parts of a text with unusual white space, or the whole text if it names a special token or holds what marks parts."""
        if _BARE in text or any(t in text for t in self.special):
            return [_BARE + text]
        return [p[1:] if p[:1] == " " and " " not in p[1:] else _BARE + p for p in _BEFORE_SPACE.split(text)]

    def parts(self, texts: pa.Array) -> pa.ListArray:
        """Parts whose ids, put together, are the text's: without the space before them, or with _BARE where there is none."""
        odd = pc.match_substring_regex(texts, _ODD)
        for t in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, t))
        odd = np.nonzero(odd.to_numpy(zero_copy_only=False))[0]
        if len(odd):
            split = self.parts(pc.if_else(pa.array(np.isin(np.arange(len(texts)), odd)), "", texts)).to_pylist()
            for k in odd.tolist():
                split[k] = self.odd_parts(texts[k].as_py())
            return pa.array(split, pa.list_(pa.string()))
        # A line's end alone is a piece of its own.
        lines = pc.binary_join_element_wise(_BARE, pc.replace_substring(texts, "\n", f" {_BARE}\n {_BARE}"), "")
        return pc.split_pattern(pc.replace_substring_regex(lines, _LETTER_MARK, rf"\1 {_BARE}\2"), " ")

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, none of which is null."""
        lists = self.parts(texts)
        parts = lists.flatten().dictionary_encode()
        named, at = parts.dictionary.to_numpy(zero_copy_only=False).tolist(), parts.indices.to_numpy()
        got = list(map(self.known.get, named))
        if None in got:
            more = self.learn({p for p, ids in zip(named, got) if ids is None})
            got = [more[p] if ids is None else ids for p, ids in zip(named, got)]
        flat = np.frombuffer(b"".join(got), "<u4")
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        starts, n = (np.cumsum(sizes) - sizes)[at], sizes[at]
        ends = np.cumsum(n)
        ids = flat[np.repeat(starts - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        return [ids[a:z] for a, z in zip(cuts, cuts[1:])]

    @staticmethod
    def each(of, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in of.encode_batch_fast(parts, add_special_tokens=False)]

    def learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of new parts, which are also kept."""
        if len(self.known) > _MOST_KEPT:
            self.known.clear()
        out: dict[str, bytes] = {}
        words, bare, rest = [], [], []
        for p in new:
            (words if _WORD(p) else bare if p[:1] == _BARE and _WORD(p[1:]) else rest).append(p)
        for at in range(0, len(rest), 1024):
            some = rest[at : at + 1024]
            out |= zip(some, self.each(self.of, [p[1:] if p[:1] == _BARE else " " + p for p in some]))
        for at in range(0, len(bare), 1024):
            some = bare[at : at + 1024]
            out |= zip(some, self.each(self.plain, [p[1:] for p in some]))
        for at in range(0, len(words), _AT_ONCE):
            some = words[at : at + _AT_ONCE]
            ids = np.array(self.plain.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            places = [*(4 * np.nonzero(self.firsts[ids])[0]).tolist(), 4 * len(ids)]
            raw = ids.tobytes()
            if len(places) == len(some) + 1:
                out |= {p: raw[a:z] for p, a, z in zip(some, places, places[1:])}
            else:
                out |= zip(some, self.each(self.plain, [" " + p for p in some]))
        self.known |= {p: ids for p, ids in out.items() if len(p) <= _LONGEST_KEPT}
        return out


def pack_ids(ids: np.ndarray, width: int) -> bytes:
    """Ids in width bytes each."""
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def _width(path: str) -> int:
    return 2 if ByteIds(path).of.get_vocab_size() <= 1 << 16 else 4


def sample_texts(docs: DataFrame, how: Files) -> list[str]:
    """Different texts of at most how.sample doc_ids, chosen by a hash of doc_id; of rows with one doc_id the least text."""
    spark = docs.sparkSession
    ids = sorted({r.doc_id for r in docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.sample).collect()})
    if not ids:
        return []
    chosen = docs.join(F.broadcast(spark.createDataFrame([(k,) for k in ids], "doc_id long")), "doc_id", "left_semi")
    return sorted(set(chosen.groupBy("doc_id").agg(F.min("text").alias("text")).toArrow().column("text").to_pylist()) - {""})


def train(texts: list[str], how: Files) -> bytes:
    """A zstandard dictionary from the serialized ids of sampled texts, up to how.sample_bytes; a raw one where there is too little to train on."""
    path = how.vocabulary or tokenizer_path()
    width, samples, total = _width(path), [], 0
    for t in texts:
        samples.append(pack_ids(ByteIds(path)(pa.array([t]))[0], width))
        total += len(samples[-1])
        if total > how.sample_bytes:
            break
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(how.dictionary_bytes, samples, level=how.level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-how.dictionary_bytes :]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def shard_body(ids: list[int | None], frames: list[bytes], counts: list[int], width: int, digest: bytes) -> bytes:
    """Head, index and frames of one shard."""
    n = len(ids)
    keys = np.array([0 if k is None else k for k in ids], "<i8").tobytes() + np.array([k is None for k in ids], "u1").tobytes()
    at = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8").tobytes()
    before = np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes()
    return b"".join([_HEAD.pack(_MAGIC, width, n, digest), keys, at, before, *frames])


class Shard:
    """A shard as read: its index, and any document by its place in it."""

    def __init__(self, body: bytes, dictionary: bytes):
        magic, self.width, n, digest = _HEAD.unpack_from(body)
        if magic != _MAGIC:
            raise ValueError("not a shard of token ids")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        self.n, at = n, _HEAD.size
        self.ids = np.frombuffer(body, "<i8", n, at)
        self.null = np.frombuffer(body, "u1", n, at + 8 * n)
        self.places = np.frombuffer(body, "<u8", n + 1, at + 9 * n)
        self.before = np.frombuffer(body, "<u8", n + 1, at + 9 * n + 8 * (n + 1))
        self.frames = memoryview(body)[at + 9 * n + 16 * (n + 1) :]
        self.open = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def document(self, k: int) -> np.ndarray:
        """Ids of the document at place k: one frame is opened."""
        raw = self.open.decompress(self.frames[int(self.places[k]) : int(self.places[k + 1])])
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def find(self, doc_id: int) -> range:
        """Places of a doc_id, by search in the index."""
        first = int(self.null.sum())  # nulls come first
        a, z = (first + int(np.searchsorted(self.ids[first:], doc_id, side)) for side in ("left", "right"))
        return range(a, z)


def _writer(path: str, dictionary: bytes, how: Files):
    width, digest, end = _width(path), hashlib.sha256(dictionary).digest(), np.array([how.end_id], "<u4")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        of = ByteIds(path)
        squeeze = zstandard.ZstdCompressor(level=how.level, dict_data=_dictionary(dictionary))
        ids, frames, counts, shard, before = [], [], [], 0, 0

        def done() -> pa.RecordBatch:
            nonlocal ids, frames, counts, shard, before
            named = [k for k in ids if k is not None]
            row = (part, shard, min(named, default=None), max(named, default=None), len(ids), before, sum(counts), shard_body(ids, frames, counts, width, digest))
            ids, frames, counts, shard, before = [], [], [], shard + 1, before + sum(counts)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SHARDS)], schema=_SHARDS)

        held = 0
        for batch in batches:
            for some in portions(batch, "text"):
                for k, tokens in zip(some.column("doc_id").to_pylist(), of(some.column("text"))):
                    ids.append(k)
                    counts.append(len(tokens) + 1)
                    frames.append(squeeze.compress(pack_ids(np.concatenate([tokens, end]), width)))
                    held += counts[-1]
                if held >= how.shard_ids:
                    yield done()
                    held = 0
        if ids:
            yield done()
        release()

    return run


@dataclass(frozen=True)
class Written:
    """What write() gives: the shards, the dictionary's table (one row: sha256, body) and the ids before each partition."""

    shards: DataFrame
    dictionary: DataFrame
    before: dict[int, int]


def write(docs: DataFrame, how: Files | None = None) -> Written:
    """Write all documents to token-id files in ascending doc_id order."""
    how = how or Files()
    spark = docs.sparkSession
    d = docs_of(docs)
    texts = sample_texts(d, how)
    dictionary = train(texts, how)
    kept = save(spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "sha256 string, body binary"), "dictionary")
    n_bytes = d.count() * sum(map(len, texts)) // max(1, len(texts))  # about: it only sets the number of partitions
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-n_bytes // how.partition_bytes), how.most_partitions))
    # Rows of one doc_id are told apart by their place in the input, so that no range of them must meet in one task.
    order = [F.col("doc_id").asc_nulls_first(), F.col("place")]
    ranged = d.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    written = ranged.select("doc_id", "text").mapInArrow(_writer(how.vocabulary or tokenizer_path(), dictionary, how), SHARDS)
    shards = save(written, "tokens", "uncompressed")
    before, total = {}, 0
    for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # a row a partition
        before[r.part] = total
        total += r.n
    return Written(shards, kept, before)


def _with_starts(files: Written) -> DataFrame:
    """(start, body) of each shard: start is the ids before it."""
    firsts = files.shards.sparkSession.createDataFrame(list(files.before.items()), "part int, before long")
    return files.shards.join(firsts, "part").select((F.col("before") + F.col("n_before")).alias("start"), "body")


def read(files: Written) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    spark = files.shards.sparkSession
    body = spark.sparkContext.broadcast(bytes(files.dictionary.first()["body"]))  # at most dictionary_bytes

    def run(batches):
        for batch in batches:
            for start, raw in zip(batch.column("start").to_pylist(), batch.column("body")):
                shard = Shard(raw.as_py(), body.value)
                ids = [None if z else k for k, z in zip(shard.ids.tolist(), shard.null.tolist())]
                crc = [zlib.crc32(shard.document(k)) for k in range(shard.n)]
                before = shard.before.astype(np.int64)
                columns = [pa.array(ids, pa.int64()), pa.array(start + before[:-1]), pa.array(np.diff(before)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=_DOCS)
        release()

    return _with_starts(files).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(files: Written, wanted: list[int]) -> DataFrame:
    """(doc_id, ids array<int>) of the named documents: only shards whose range holds one are read, and only their frames opened."""
    spark: SparkSession = files.shards.sparkSession
    body = spark.sparkContext.broadcast(bytes(files.dictionary.first()["body"]))
    asked = sorted(set(wanted))
    near = F.lit(False)
    for k in asked:
        near = near | ((F.col("first_id") <= k) & (F.col("last_id") >= k))

    def run(batches):
        for batch in batches:
            for raw in batch.column("body"):
                shard = Shard(raw.as_py(), body.value)
                for k in asked:
                    for place in shard.find(k):
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([shard.document(place).tolist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return files.shards.where(near).select("body").mapInArrow(run, "doc_id long, ids array<int>")
