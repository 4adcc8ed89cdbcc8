"""Secret scan in DataFrame functions only.

Three patterns find known forms. Besides these, long tokens face a battery of randomness tests under the encoding their
letters suggest: chi-squared uniformity over its alphabet, Wald-Wolfowitz runs about the middle of the alphabet, and lag-1
serial correlation. A token that fails one of them is not random. One that passes is compared with what prose of its length
would give: the chi-squared statistic of prose has a mean that grows with the length, so short tokens carry little evidence.
These p-values go through Benjamini-Hochberg control within each class of lengths, over all tokens of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervane.llm.common import docs_of, save

# The three base patterns, their order and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]

TOKEN = r"[A-Za-z0-9+/_-]{20,}"
# Encodings in the order they are tried, with their alphabets.
_AZ, _09 = "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = [
    ("decimal", r"^[0-9]+$", _09),
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", _09 + "abcdef"),
    ("lower", r"^[a-z]+$", _AZ),
    ("base32", r"^[A-Z2-7]+$", _AZ.upper() + "234567"),
    ("base36", r"^[a-z0-9]+$", _09 + _AZ),
    ("base62", r"^[A-Za-z0-9]+$", _09 + _AZ.upper() + _AZ),
    ("base64", r".", _09 + _AZ.upper() + _AZ + "+/-_"),
]
#: Chance that two letters of prose are the same; English and its neighbours lie between 0.065 and 0.08.
PROSE_REPEAT = 0.066
_BINS, _PER_DECADE = 1600, 100
_CLASSES = (20, 32, 48, 96)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once: a lambda variable holds it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _largest(numbers: Column) -> Column:
    return F.coalesce(F.array_max(numbers), F.lit(0))


#: Numbers that a running total or maximum goes through one by one; larger runs are taken from totals of so many, and of so many of these.
_RUN = 64


def running(numbers: Column, fold: Callable[[Column], Column], then: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """then(before), where before(i) folds the numbers before place i: at most 64 of them, 64 totals of 64, and totals of 4096.

    No more than 64 numbers are folded as they are.
    """
    def div(i: Column, n: int) -> Column:
        return F.floor(i / n).cast("int")

    def folded(of: Column) -> Column:
        blocks = F.sequence(F.lit(0), div(F.size(of) - 1, _RUN))
        return F.when(F.size(of) > 0, F.transform(blocks, lambda j: fold(F.slice(of, j * _RUN + 1, F.lit(_RUN))))).otherwise(F.array().cast("array<int>"))

    def use(s: Column) -> Column:
        def before(i: Column) -> Column:
            far = F.slice(s["coarse"], F.lit(1), div(i, _RUN * _RUN))
            near = F.slice(s["blocks"], div(i, _RUN * _RUN) * _RUN + 1, div(i, _RUN) % _RUN)
            own = F.slice(s["each"], div(i, _RUN) * _RUN + 1, i % _RUN)
            return fold(F.array(fold(far), fold(near), fold(own)))

        return then(before)

    def long(x: Column) -> Column:
        with_blocks = F.struct(x.alias("each"), folded(x).alias("blocks"))
        return let(let(with_blocks, lambda s: F.struct(s["each"].alias("each"), s["blocks"].alias("blocks"), folded(s["blocks"]).alias("coarse"))), use)

    return let(numbers, lambda x: F.when(F.size(x) <= _RUN, then(lambda i: fold(F.slice(x, F.lit(1), i)))).otherwise(long(x)))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start:int,stop:int,hit:string>> of leftmost non-overlapping matches, in code points, stop exclusive."""

    def found(s: Column) -> Column:
        def placed(before: Callable[[Column], Column]) -> Column:
            begin = lambda i: before(i) + s["gaps"][i]
            return F.transform(s["hits"], lambda h, i: let(begin(i), lambda at: F.struct(at.alias("start"), (at + F.length(h)).alias("stop"), h.alias("hit"))))

        steps = F.transform(s["hits"], lambda h, i: s["gaps"][i] + F.length(h))
        return running(steps, _total, placed)

    none = F.array().cast("array<struct<start:int,stop:int,hit:string>>")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.struct(hits.alias("hits"), F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gaps"))
    return F.when(text.rlike(pattern), let(parts, found)).otherwise(none)


def apart(found: Column, base: Column) -> Column:
    """Those of found, which do not overlap each other, that overlap none of the base spans; both are sorted by start.

    In one order of all starts, a token is hit by a base span that begins before it and ends beyond its start, or by the next
    span; a token in between ends before it begins.
    """
    mark = lambda m, kind, hit: F.struct(m["start"].alias("start"), F.lit(kind).alias("own"), m["stop"].alias("stop"), hit.alias("hit"))
    all_ = F.array_sort(F.concat(F.transform(base, lambda m: mark(m, 0, F.lit(""))), F.transform(found, lambda m: mark(m, 1, m["hit"]))))

    def free(events: Column) -> Column:
        stops = F.transform(events, lambda m: F.when(m["own"] == 0, m["stop"]).otherwise(0))

        def alone(before: Callable[[Column], Column]) -> Column:
            def ok(m: Column, i: Column) -> Column:
                after = F.get(events, i + 1)
                cut = (after["own"] == 0) & (after["start"] < m["stop"])
                return (m["own"] == 1) & (before(i) <= m["start"]) & ~F.coalesce(cut, F.lit(False))

            return F.transform(F.filter(events, ok), lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), m["hit"].alias("hit")))

        return running(stops, _largest, alone)

    return F.when((F.size(base) == 0) | (F.size(found) == 0), found).otherwise(let(all_, free))


def base_spans(text: Column) -> Column:
    """array<struct<start:int,kind:int,stop:int>> of the three base patterns, by start and then kind."""
    long_enough = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= 6)
    each = [_of_kind(found, k) for k, found in enumerate((long_enough, matches(text, ACCESS), matches(text, HEX)))]
    return F.array_sort(F.concat(*each))


def _of_kind(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["stop"].alias("stop")))


def count_of(kind: int, of: str = "base") -> Column:
    return F.size(F.filter(of, lambda s: s["kind"] == kind)).cast("long")


def _phi(z: Column) -> Column:
    """Normal distribution function, by its complementary error function's exponential bound form; relative error small in the lower tail."""
    a = F.abs(z)
    tail = F.exp(-a * a / 2) / (a + F.sqrt(a * a + 8 / 3.141592653589793)) * 0.7978845608028654
    return F.when(z < 0, tail).otherwise(1 - tail)


def battery(token: Column) -> Column:
    """struct<random:boolean, p:double, encoding:string>: whether no test rejects uniform randomness, and the p-value against prose of that length."""
    n = F.length(token).cast("double")
    case = F.when(F.lit(False), F.lit(None))
    for name, pattern, alphabet in ENCODINGS:
        k, half = len(alphabet), len(alphabet) // 2
        t = F.lower(token) if name == "hex" else token
        letters = F.array(*map(F.lit, alphabet))
        squares = F.aggregate(letters, F.lit(0.0), lambda a, c: a + F.pow(F.length(t) - F.length(F.replace(t, c, F.lit(""))), F.lit(2.0)))
        chi = squares * k / n - n
        bits = F.translate(t, alphabet, "0" * half + "1" * (k - half))
        ones = F.length(F.replace(bits, F.lit("0"), F.lit(""))).cast("double")
        runs = F.regexp_count(bits, F.lit("01")) + F.regexp_count(bits, F.lit("10")) + 1
        q = (k - half) / k
        runs_z = (runs - (1 + 2 * q * (1 - q) * (n - 1))) / F.sqrt(4 * n * q * (1 - q) * (1 - 3 * q * (1 - q)))
        index = F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - (k + 1) / 2)
        serial = let(index, lambda x: F.aggregate(F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
        serial_z = serial / (F.sqrt(n) * (k * k - 1) / 12)
        delta = max(k * PROSE_REPEAT - 1, 0.7)
        spread = (2 * (k - 1)) ** 0.5
        random = (F.abs((chi - (k - 1)) / spread) < 4.0) & (F.abs(runs_z) < 3.5) & (F.abs(serial_z) < 3.5) & (ones > 0) & (ones < n)
        z = (chi - (k - 1) - n * delta) / F.sqrt(2 * (k - 1) + 4 * n * delta)
        case = case.when(token.rlike(pattern), F.struct(random.alias("random"), _phi(z).alias("p"), F.lit(name).alias("encoding")))
    return case


def _length_class(start: Column, stop: Column) -> Column:
    return sum(((stop - start) >= c).cast("int") for c in _CLASSES)


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, base, tokens): base spans and tested tokens that overlap none of them, for each row of docs. No text is carried."""
    d = docs_of(docs)
    d = d.select("doc_id", base_spans(F.col("text")).alias("base"), matches(F.col("text"), TOKEN).alias("found"))
    tokens = F.transform(apart(F.col("found"), F.col("base")), lambda m: let(battery(m["hit"]), lambda t: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), t["random"].alias("random"), t["p"].alias("p"))))
    return d.select("doc_id", "base", tokens.alias("tokens"))


def thresholds(found: DataFrame, alpha: float = 0.01) -> dict[int, float]:
    """Largest p-value discovered in each length class by Benjamini-Hochberg at rate alpha, over all tokens of the corpus.

    p-values are rounded up to a grid of a hundredth of a decade: at most len(_CLASSES) * 1600 counts come to the driver.
    """
    t = found.select(F.explode("tokens").alias("t")).select(_length_class(F.col("t.start"), F.col("t.stop")).alias("c"), F.least(F.floor(-F.log10(F.greatest(F.col("t.p"), F.lit(1e-300))) * _PER_DECADE), F.lit(_BINS - 1)).alias("bin"), F.col("t.random").cast("long").alias("r"))
    counts = t.groupBy("c", "bin").agg(F.count("*").alias("n"), F.sum("r").alias("r")).collect()
    out = {}
    for c in {r.c for r in counts}:
        of = sorted((r for r in counts if r.c == c), key=lambda r: -r.bin)
        total, seen = sum(r.n for r in of), 0
        for r in of:
            seen += r.r or 0  # tokens that fail the battery are never discovered, but count as tests
            if (p := 10 ** (-r.bin / _PER_DECADE)) <= alpha * seen / total:
                out[c] = p
    return out


def spans(found: DataFrame, alpha: float = 0.01) -> DataFrame:
    """(doc_id, base, spans): spans has base and the discovered random tokens, by start and then kind."""
    limits = thresholds(found, alpha)

    def hit(t: Column) -> Column:
        is_hit = F.lit(False)
        for c, p in sorted(limits.items()):
            is_hit = is_hit | ((_length_class(t["start"], t["stop"]) == c) & (F.floor(-F.log10(F.greatest(t["p"], F.lit(1e-300))) * _PER_DECADE) >= round(-_PER_DECADE * math.log10(p))))
        return t["random"] & is_hit

    more = _of_kind(F.filter("tokens", hit), 3)
    return found.select("doc_id", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def joined(of: Column) -> Column:
    """kind:start:stop, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame, alpha: float = 0.01) -> DataFrame:
    """One row for each row of docs (null texts are empty, null ids stay null): (doc_id, base, spans). Texts are read once."""
    return spans(save(findings(docs), "secrets"), alpha)


def redact(docs: DataFrame, alpha: float = 0.01, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by mark and n_chars, if there, set anew. Rows without a finding stay as they are.

    The thresholds come from a first pass over all rows; the second pass finds the spans again beside the texts, so that no
    text is shuffled.
    """
    limits = spans_of_thresholds(thresholds(save(findings(docs), "secrets"), alpha))
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = let(limits(text), lambda s: F.when(F.size(s) > 0, _replace(text, s, mark)))
    out = docs.withColumn("__scan_cut", cut)
    out = out.withColumn("text", F.coalesce("__scan_cut", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__scan_cut").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def spans_of_thresholds(limits: dict[int, float]) -> Callable[[Column], Column]:
    """text -> all spans, given the discovery limits."""

    def hit(m: Column) -> Column:
        def passes(t: Column) -> Column:
            ok = F.lit(False)
            for c, p in sorted(limits.items()):
                ok = ok | ((_length_class(m["start"], m["stop"]) == c) & (F.floor(-F.log10(F.greatest(t["p"], F.lit(1e-300))) * _PER_DECADE) >= round(-_PER_DECADE * math.log10(p))))
            return t["random"] & ok

        return let(battery(m["hit"]), passes)

    def run(text: Column) -> Column:
        def both(s: Column) -> Column:
            more = _of_kind(F.filter(apart(s["found"], s["base"]), hit), 3)
            return F.array_sort(F.concat(s["base"], more))

        return let(F.struct(base_spans(text).alias("base"), matches(text, TOKEN).alias("found")), both)

    return run


def _replace(text: Column, of: Column, mark: str) -> Column:
    """text with the spans, sorted by start, replaced; overlapping spans give one mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, s: Column) -> Column:
        fresh = F.concat(a["parts"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))
        return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), F.when(s["start"] >= a["at"], fresh).otherwise(a["parts"]).alias("parts"))

    return F.aggregate(of, start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text))))
