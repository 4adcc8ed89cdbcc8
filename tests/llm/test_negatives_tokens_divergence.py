"""Hard negatives, token-id files and source divergence against brute force, on small and awkward tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from intervane.llm import hard_negatives as H
from intervane.llm import source_divergence as S
from intervane.llm import token_files as T

# --- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, rank string, cells string, row_group string"


def vectors(n=700, seed=3):
    r = random.Random(seed)
    same = [r.gauss(0, 0.1) for _ in range(6)]
    out = []
    for k in range(n):
        v = same if k % 3 == 0 else [r.gauss(0, 0.1) for _ in range(6)]  # a third of all rows have one vector
        out.append((k, [float(np.float32(x)) for x in v], 1 if k % 3 == 0 and k % 2 else r.randrange(4), "c", "c", "c"))
    out += [(100, out[100][1], 9, "c", "c", "c"), (None, same, 1, "c", "c", "c"), (2100, None, 1, "c", "c", "c"), (2200, [float("nan")] * 6, 1, "c", "c", "c")]
    out += [(2300, [None] * 6, 1, "c", "c", "c"), (2400, [float("inf")] + same[1:], 1, "c", "c", "c"), (2500, same, None, "c", "c", "c")]
    out += [(2600, [0.3, -0.2], 1, "c", "c", "c"), (2700, [], 2, "c", "c", "c"), (2800, [1e30] + same[1:], 1, "c", "c", "c")]
    return out


def brute_negatives(rows, how):
    import math

    kept = {}
    for k, v, label, *_ in rows:
        if k is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(max(-(2.0**24), min(2.0**24, float(np.float32(x)) * 256))) for x in v]
        kept[k] = min(kept.get(k, (label, q)), (label, q))
    score = lambda a, b: sum(x * y for x, y in zip(kept[a][1], kept[b][1]))
    out = []
    for a in kept:
        if a % how.anchor_every:
            continue
        order = sorted(((-score(a, b), b) for b in kept if b != a))
        for s, p in [x for x in order if kept[x[1]][0] == kept[a][0]][: how.positives]:
            fit = [(m, b) for m, b in order if kept[b][0] != kept[a][0] and 80 * -s <= 100 * -m <= 100 * -s]
            out += [(a, p, k + 1, b, -s, -m) for k, (m, b) in enumerate(fit[: how.negatives])]
    return sorted(out)


@pytest.mark.parametrize("how", [H.Mining(cells=4, rows_a_tile=100, anchors_a_tile=3), H.Mining(), H.Mining(sample=1, anchor_every=50)])
def test_negatives_equal_brute_force(spark, how):
    rows = vectors()
    got = H.mine(spark.createDataFrame(rows, VECTORS).repartition(3), how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, how)


def test_negatives_of_no_rows_and_of_one_label(spark):
    assert H.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert H.mine(spark.createDataFrame([(k, [1.0], 1, "", "", "") for k in range(300)], VECTORS)).count() == 0


def test_bounds_hold_and_leave_out_most_rows():
    r = np.random.default_rng(1)
    q = np.floor(256 * r.normal(0, 0.125, (4000, 64))).astype(np.int64)
    cells = H.Cells.of(q[:500], q.min(0), q.max(0), 128)
    low, high = cells.bounds(q[:8], cells.place(q))
    exact = q @ q[:8].T
    assert (low <= exact).all() and (exact <= high).all()
    fifth = np.sort(low, axis=0)[-5]
    assert ((high >= fifth).sum(axis=0) < 200).all()


# --- token files

DOCS = "doc_id long, text string, lang string, source string, n_chars long, body string, part string"
TEXTS = [
    "a", "", None, "A b  c", " lead", "trail ", "x\n\ny", "x\ny", "one.\nTwo", "tab\there", "a \n b", "don't we've I'll", "café über straße naïve.", "日本語の 文", "1,234.5 km/h",
    "<|endoftext|> inside <|endoftext|>", "a\x00b c", "  　x", "× 2÷7", "word" * 4000, "é combining", "\U0001f600 smile :-)", "a.b.c d", "(x)[y]{z}", "  ", "\n", " \x00x", "A's 's s'", "x᠎ y",
]


def token_rows():
    r = random.Random(2)
    alphabet = ["a", "B", "é", " ", " ", "\n", ".", ",", "'", "s", "7", "ß", "-", "\t", "日", "'s"]
    made = TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(150)] + ["same text"] * 40
    rows = [(k * 3 % 1000 - 20, t, "en", "s", 1, "clash", "clash") for k, t in enumerate(made)]
    return rows + [(None, "no id", "en", "s", 1, "", ""), (None, None, "en", "s", 1, "", ""), (4, "id twice", "en", "s", 1, "", ""), (4, "id twice", "en", "s", 1, "", "")]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.tokenizer_path())


@pytest.mark.parametrize("how", [T.Files(shard_ids=100, sample_bytes=20_000), T.Files(sample=0)])
def test_tokens_round_trip(spark, tokenizer, how):
    rows = token_rows()
    files = T.write(spark.createDataFrame(rows, DOCS).repartition(3), how)
    got = T.read(files).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k))
    ids = lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    want = Counter((k, len(ids(t)), zlib.crc32(ids(t).tobytes())) for k, t, *_ in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    found = T.fetch(files, [4, -20, 999_999]).collect()
    assert sorted((r.doc_id, r.ids) for r in found) == sorted((k, ids(t).tolist()) for k, t, *_ in rows if k in (4, -20))
    assert T.Shard(bytes(files.shards.first().body), bytes(files.dictionary.first().body)).n > 0
    with pytest.raises(ValueError):
        T.Shard(bytes(files.shards.first().body), b"another")


def test_tokens_of_no_rows(spark):
    assert T.read(T.write(spark.createDataFrame([], DOCS))).count() == 0


def test_ids_equal_the_library_in_every_batch(tokenizer):
    texts = [t or "" for _, t, *_ in token_rows()]
    got = T.ByteIds(T.tokenizer_path())(pa.array(["cut off", *texts]).slice(1))
    assert [x.tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# --- source divergence

TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def audit_rows():
    r = random.Random(8)
    pool = ["alpha", "Beta", "GAMMA", "été", "ÉTÉ", "日本", "naïve", "a", "ab", "abc", "abcdefgh", "abcdefghi", "abcdefghijklmnopq", "z" * 300, "rare"]
    rows = [(k, " ".join(r.choice(pool[: 6 + k % 10]) for _ in range(r.randrange(1, 40))) + r.choice(["", ".", " 42!"]), r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", None])) for k in range(120)]
    rows += [(k, "hot hot term", "en", "s1") for k in range(60)] + [(None, None, "en", "empty"), (1, "", "fr", "x"), (1, "one", "fr", "y"), (2, "12 34", None, "digits"), (3, "\x00a\x7fb", "en", "s9")]
    return [(*x, 1, "clash", "clash") for x in rows]


def brute_audit(rows, how):
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    groups, documents = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        terms = TERM.findall(low(text or ""))
        groups[lang or "", source or ""].update(terms)
        documents[lang or ""].update(set(terms))
    out = []
    for lang, of in documents.items():
        kept = sorted((t for t, n in of.items() if n >= how.least_documents), key=str.encode)

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + how.unit * (c[t] + 1) // (n + len(kept)) for t in kept}

        mine = {s: c for (x, s), c in groups.items() if x == lang}
        whole = shares(sum(mine.values(), Counter()))
        p = {s: shares(c) for s, c in mine.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s, c in mine.items():
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in mine if o != s]
            terms = [(-f(p[s][t], whole[t]), t) for t in kept if c[t] > 0 and p[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, how.most_terms)):
                out += [(lang, s, part, o, -v, k + 1) for k, (v, o) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode()))[:most])]
    return sorted(out)


AUDIT_DOCS = "doc_id long, text string, lang string, source string, rank long, item string, trie string"


@pytest.mark.parametrize("how", [S.Audit(), S.Audit(portion_bytes=300, range_terms=3, sample=40, most_terms=2), S.Audit(least_documents=1, unit=97)])
def test_divergence_equals_brute_force(spark, how):
    rows = audit_rows()
    got = S.compare(spark.createDataFrame(rows, AUDIT_DOCS).repartition(4), how)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == brute_audit(rows, how)


def test_divergence_of_no_rows_and_of_one_source(spark):
    assert S.compare(spark.createDataFrame([], AUDIT_DOCS)).count() == 0
    assert S.compare(spark.createDataFrame([(k, "same words", "en", "s", 1, "", "") for k in range(9)], AUDIT_DOCS)).count() == 0


def test_tries_order_merge_and_round_trip():
    r = random.Random(4)
    terms = list({bytes(r.choice(b"ab\xc3\xff") for _ in range(r.randrange(1, 30))) for _ in range(600)}) + [b"a" * 5000, b"a" * 4999]
    ends, data = np.cumsum([len(t) for t in terms]), np.frombuffer(b"".join(terms), np.uint8)
    assert S.ranks(ends, data).tolist() == [sorted(terms).index(t) for t in terms]
    one, n = np.ones(len(terms), np.int64), np.arange(len(terms))
    trie = S.Trie.of(ends, data, one, n, n % 3, one * 2)
    assert [trie.term(k) for k in range(len(trie))] == sorted(terms)
    names, both = S.merge([(["x", "y", "z"], trie), (["z", "x", "y"], S.Trie.load(trie.part(10, 200).dump())), ([], S.Trie.load(trie.part(0, 0).dump()))])
    assert names == ["x", "y", "z"] and both.documents.sum() == len(terms) + 190 and both.count.sum() == 2 * (len(terms) + 190)
    assert [both.term(k) for k in range(len(both))] == sorted(terms)


def test_large_counts_are_exact():
    big = np.array([10**13, 3], object)
    assert S._shares(big, 10**13 + 3, 2, 10**9).tolist() == [1 + 10**9 * (10**13 + 1) // (10**13 + 5), 1 + 10**9 * 4 // (10**13 + 5)]
