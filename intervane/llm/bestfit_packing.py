"""Vector best-fit packing of documents into token sequences.

Pieces of equal length are interchangeable, so bins are chosen over the histogram of lengths (at most ``capacity`` rows,
whatever the corpus) and then dealt out to the pieces by their rank within their length. Each step of the packer fixes a
pattern, repeats it as often as the counts allow and so uses up at least one length: there are at most ``capacity``
patterns, each with fewer than sqrt(2*capacity)+1 different lengths, which bounds what is broadcast.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_right
from dataclasses import dataclass
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervane.llm.common import docs_of, from_rows, save, slices

VOCABULARY = "word_bpe_49k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_CACHE_WORDS = 1_000_000


_PUNCTUATION = b"!#$%&()*+,-./:;<=>?@[]^_|~"
_MARKS = re.compile(rb"[!-/:-@\[-`{-~]+")
_TAIL = re.compile(rb"(?<=[A-Za-z0-9])[!#-&(-/:-@\[-_{-~]+(?=[ \t-\r]|$)")
_KNOWN: dict[str, tuple] = {}


def tokenizer_path(name: str = VOCABULARY) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Token ids of texts as little-endian 32-bit bytes.

    The tokenizer drops white space and never joins across it, so ids are found once for each word between ASCII white
    space. A word that ends in a letter or digit and then punctuation splits there too. Words of letters alone are encoded
    many at a time: each gives tokens up to the next that ends a word. The store of a worker lasts from task to task and is
    emptied when full.
    """

    def __init__(self, path: str):
        if path not in _KNOWN:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer, models, pre_tokenizers

            of = Tokenizer.from_file(path)
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)["model"]
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["merges"]]
            # For words of small letters in normal form the tokenizer's normaliser does nothing, and its pattern cuts at spaces alone.
            plain = Tokenizer(models.BPE(vocab=spec["vocab"], merges=merges, cache_capacity=0, end_of_word_suffix=spec["end_of_word_suffix"]))
            plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            ends = {i for token, i in spec["vocab"].items() if token.endswith(spec["end_of_word_suffix"])}
            _KNOWN[path] = (of, plain, ends, {})
        self.of, self.plain_of, self.ends, self.known = _KNOWN[path]

    def __call__(self, texts: list[str]) -> list[bytes]:
        docs = [self.split(t) for t in texts]
        if len(self.known) > _CACHE_WORDS:
            self.known.clear()
        known = self.known
        new = set(chain.from_iterable(docs)).difference(known)
        if new:
            self.learn(new)
        get = known.__getitem__
        return [b"".join(map(get, doc)) for doc in docs]

    @staticmethod
    def split(text: str) -> list[bytes]:
        """Parts whose ids, put together, are the text's: between white space, and at marks where no token can cross."""
        b = text.encode("utf-8", "surrogatepass")
        if b"<|" in b:
            return b.split()
        if text.isascii() and b"'" not in b:
            return _MARKS.sub(rb" \g<0> ", b.lower()).split()
        return _TAIL.sub(rb" \g<0>", b).split()

    def learn(self, new: set[bytes]) -> None:
        stems = self.known
        later, letters, rest = [], {}, {}
        for w in new:
            if w.isalpha() and w.islower():
                letters[w] = None
                continue
            core = w.rstrip(_PUNCTUATION)
            low = core.lower()
            if not low.isalpha():  # not ASCII letters alone
                low = self.plain(w, core, low, letters, rest)
                if low is w:
                    core = w
            elif low not in stems:
                letters[low] = None
            tail = w[len(core) :]
            if tail and tail not in stems:
                rest[tail] = None
            if tail or low != w:
                later.append((w, low, tail))
        self.encode_letters(list(letters), rest)
        self.encode_each([p.decode() for p in rest])
        for w, low, tail in later:
            stems[w] = stems[low] + stems[tail] if tail else stems[low]

    def plain(self, w: bytes, core: bytes, low: bytes, letters: dict, rest: dict) -> bytes:
        """What to encode of a word that isn't ASCII letters and a tail; w itself if it must not be split."""
        s = core.decode()
        if s.isalpha() and s == s.lower() and is_normalized("NFC", s):
            if low not in self.known:
                letters[low] = None
            return low
        special = b"<|" in w and b"|>" in w  # may be a special token, which is matched as it stands
        if special or not core[-1:].isalnum():
            low = w
        elif not core.isascii():
            low = core
        if low not in self.known:
            rest[low] = None
        return low

    def encode_letters(self, parts: list[bytes], rest: dict) -> None:
        known, ends = self.known, self.ends
        for at in range(0, len(parts), 1024):
            some = parts[at : at + 1024]
            ids = self.plain_of.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids
            cuts = [4 * k for k, i in enumerate(ids, 1) if i in ends]
            if len(cuts) != len(some):
                rest.update(dict.fromkeys(some))
                continue
            raw, begin = array("I", ids).tobytes(), 0
            for w, end in zip(some, cuts):
                known[w] = raw[begin:end]
                begin = end

    def encode_each(self, parts: list[str]) -> None:
        for at in range(0, len(parts), 1024):
            some = parts[at : at + 1024]
            for s, e in zip(some, self.of.encode_batch_fast(some, add_special_tokens=False)):
                self.known[s.encode()] = array("I", e.ids).tobytes()


def cut(ids: bytes, doc_id: int | None, capacity: int, end_id: int) -> list[tuple]:
    """Pieces of a document, whose ids get end_id at the end; only a document over capacity is cut."""
    ids += end_id.to_bytes(4, "little")
    step = 4 * capacity
    return [(doc_id, k, at // 4, len(part := ids[at : at + step]) // 4, zlib.crc32(part)) for k, at in enumerate(range(0, len(ids), step))]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Token pieces of every document. Empty and null texts give one piece that holds end_id alone.

    tokenizer: path of the tokenizer's file on every executor; by default that of the public one, as each executor finds it.
    """

    def run(batches):
        ids = WordIds(tokenizer or tokenizer_path())
        for batch in batches:
            for part in slices(batch, 128):
                names, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                yield from_rows([row for name, b in zip(names, ids(texts)) for row in cut(b, name, capacity, end_id)], _PIECES)

    return docs_of(docs).mapInArrow(run, PIECES)


@dataclass
class Limits:
    """Capacities of a bin. attention: sum of squared piece lengths.

    The defaults are the packing contract's: it bounds tokens alone, so the other two are set where they never bind. weights:
    of tokens, documents and attention in the scores.
    """

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.05, 0.25)
    rule: str = "dot"  # or "residual": least weighted norm of what is left


def fit(counts: dict[int, int], limits: Limits) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Bins by vector best fit over {length: count}: (first bin, bins, [(length, pieces of it), ...]).

    A bin opens with the longest piece left. A piece of length n asks for (n, 1, n * n) of tokens, documents and attention; all
    are taken as parts of the capacities. Of the lengths that fit every residual capacity, the one is added whose demand has the
    largest weighted dot product with the residual vector, or, by the rule "residual", leaves the least weighted norm of it;
    between equals the longer one. When the best would leave a gap that two smaller lengths fill exactly within every capacity,
    those two are taken. A piece that breaks a capacity on its own has a bin to itself.
    """
    if limits.rule not in ("dot", "residual"):
        raise ValueError("rule must be dot or residual")
    sizes = np.array(sorted(counts), dtype=np.int64)
    left = np.array([counts[n] for n in sizes.tolist()], dtype=np.int64)
    place = {n: k for k, n in enumerate(sizes.tolist())}
    caps = np.array([limits.tokens, limits.documents, limits.attention], dtype=np.float64)
    asks = np.stack([sizes, np.ones_like(sizes), sizes * sizes], axis=1)
    parts, weights = asks / caps, np.array(limits.weights)
    out, first, top = [], 0, len(sizes) - 1
    while True:
        while top >= 0 and not left[top]:
            top -= 1
        if top < 0:
            return out
        room, used, free = caps - asks[top], {top: 1}, left.copy()
        free[top] -= 1
        while (room > 0).all():
            end = int(np.searchsorted(sizes, room[0], side="right"))
            ok = np.nonzero((free[:end] > 0) & (sizes[:end] * sizes[:end] <= room[2]))[0]
            if not len(ok):
                break
            if limits.rule == "dot":
                score = parts[ok] @ (weights * room / caps)
            else:
                score = -(((room / caps - parts[ok]) ** 2) @ weights)
            best = int(ok[np.nonzero(score == score.max())[0][-1]])
            add = [best]
            if sizes[best] < room[0] and room[1] >= 2:
                add = _pair(ok, sizes, free, place, room) or add
            for k in add:
                used[k] = used.get(k, 0) + 1
                free[k] -= 1
                room = room - asks[k]
        times = min(int(left[k]) // n for k, n in used.items())
        out.append((first, times, sorted(((int(sizes[k]), n) for k, n in used.items()), reverse=True)))
        first += times
        for k, n in used.items():
            left[k] -= n * times


def _pair(ok: np.ndarray, sizes: np.ndarray, free: np.ndarray, place: dict[int, int], room: np.ndarray) -> list[int] | None:
    """Two lengths that fill the tokens left exactly, the longer one as long as can be."""
    for a in ok[sizes[ok] * 2 >= room[0]][::-1].tolist():
        n = int(sizes[a])
        b = place.get(int(room[0]) - n)
        if b is not None and free[b] > (a == b) and n * n + int(sizes[b]) ** 2 <= room[2]:
            return [a, b]
    return None


def places(patterns) -> dict[int, tuple[list[int], list[tuple[int, int, int]]]]:
    """For each length: rank breakpoints, and for each range (first bin, bins, offset) where its pieces go."""
    out: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
    done: dict[int, int] = {}
    for first, times, parts in patterns:
        offset = 0
        for n, k in parts:
            starts, where = out.setdefault(n, ([], []))
            if not starts or where[-1] != (first, times, offset, k):
                starts.append(done.get(n, 0))
                where.append((first, times, offset, k))
            done[n] = done.get(n, 0) + k * times
            offset += n * k
    return out


#: Rows that one task ranks, and (length, salt) pairs that a large corpus may have beyond one for each length.
_ROWS_A_SALT, _SALTS = 512, 100_000


def pack(cut_pieces: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Give each piece a sequence and a gapless offset: cut_pieces plus (sequence_id, offset).

    Rows with the same doc_id and piece number are different pieces. A third of all pieces may have one length: ranks within
    a length are counted per (length, salt) and shifted by the sums of the salts before. A length has a salt for each 512
    pieces of it, or fewer, so that all pairs are no more than 100,000 beyond the lengths: these numbers come to the driver.
    A piece that breaks a limit on its own gets a bin for itself.
    """
    limits = limits or Limits()
    spark = cut_pieces.sparkSession
    table = save(cut_pieces, "pieces")
    counts = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}  # at most capacity rows
    a_salt = max(_ROWS_A_SALT, -(-sum(counts.values()) // _SALTS))
    many = {n: -(-k // a_salt) for n, k in counts.items() if k > a_salt}
    salts = spark.createDataFrame(list(many.items()), "length long, _salts long")  # at most capacity rows
    table = table.join(F.broadcast(salts), "length", "left").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.coalesce("_salts", F.lit(1))))
    shift: dict[tuple[int, int], int] = {}
    before: dict[int, int] = {}
    if many:
        by_salt = table.where("_salts is not null").groupBy("length", "_salt").count().collect()
        for r in sorted(by_salt, key=lambda r: (r["length"], r["_salt"])):
            shift[r["length"], r["_salt"]] = before.get(r["length"], 0)
            before[r["length"]] = before.get(r["length"], 0) + r["count"]
    where = spark.sparkContext.broadcast((shift, places(fit(counts, limits))))
    ranked = table.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    fields = [f for f in cut_pieces.schema.fields]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"

    def run(batches):
        shift, spots = where.value
        for batch in batches:
            seq, off = [], []
            for n, salt, rank in zip(*(batch.column(c).to_pylist() for c in ("length", "_salt", "_rank"))):
                rank += shift.get((n, salt), 0)
                starts, ranges = spots[n]
                i = bisect_right(starts, rank) - 1
                first, times, offset, k = ranges[i]
                bin_no, slot = divmod(rank - starts[i], k)
                seq.append(first + bin_no)
                off.append(offset + slot * n)
            keep = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=[*(f.name for f in fields), "sequence_id", "offset"])

    return ranked.mapInArrow(run, types)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, limits: Limits | None = None, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document."""
    limits = limits or Limits()
    return pack(pieces(docs, tokenizer, limits.tokens, end_id), limits)
