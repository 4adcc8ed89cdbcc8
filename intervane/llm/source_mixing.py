"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked to the three target marginals of a token budget in turn. No
cell can weigh more than it has, so weights are held to that within each step, and the other cells of the marginal make up
for it in the steps to come. A document's probability of being kept is its cell's weight over what the cell has. Cells are
bounded by the targets: values without a target fall into "other", so there are at most the product of the targets' sizes
plus one each. Targets that the documents cannot fill leave a residual, which residuals() and marginals() tell.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("source", "lang", "topic")
OTHER = "other"


@dataclass(frozen=True)
class Targets:
    """Shares of tokens wanted for each value of an axis; they are scaled to the values that occur.

    other: the share of all values without a target. topic_column: the column that names a document's topic; by default the
    coarse marks of topic() stand for one. budget: tokens to keep, as a part of all.
    """

    source: dict[str, float] = field(default_factory=lambda: {f"src{k}": 1.0 for k in range(20)})
    lang: dict[str, float] = field(default_factory=lambda: {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15})
    topic: dict[str, float] = field(default_factory=lambda: {"prose": 0.9, "listing": 0.04, "legal": 0.03, "contact": 0.03})
    other: float = 0.01
    budget: float = 0.6
    rounds: int = 20
    seed: int = 7
    topic_column: str | None = None

    def of(self, axis: str) -> dict[str, float]:
        own = getattr(self, axis)
        return {**own, OTHER: self.other * sum(own.values())}


def tokens(text: Column) -> Column:
    """Weight of a document: words between ASCII white space, at least one."""
    return F.greatest(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")


def topic(text: Column) -> Column:
    """Coarse topic by marks in the text; the first that fits."""
    return (
        F.when(text.contains("Licensed under") | text.contains("All rights reserved"), "legal")
        .when(text.contains(" | "), "listing")
        .when(text.contains("@") | text.contains("http"), "contact")
        .otherwise("prose")
    )


def _known(value: Column, values: dict[str, float]) -> Column:
    return F.when(value.isin(*values), value).otherwise(OTHER)


def with_cells(docs: DataFrame, targets: Targets) -> DataFrame:
    """docs with __mix_source, __mix_lang, __mix_topic (values without target and nulls: other) and __mix_tokens."""
    text = F.coalesce(F.col("text"), F.lit(""))
    about = F.col(targets.topic_column) if targets.topic_column else topic(text)
    cells = {"source": F.col("source"), "lang": F.col("lang"), "topic": about}
    known = {f"__mix_{axis}": _known(value, getattr(targets, axis)) for axis, value in cells.items()}
    return docs.withColumns({**known, "__mix_tokens": tokens(text)})


def rake(cells: dict[tuple, float], targets: Targets) -> dict[tuple, float]:
    """Raked weights of the cells, {(source, lang, topic): tokens}, none above the cell's own tokens.

    Every axis in turn, targets.rounds times: the weights of a value are scaled to its share of the budget, each held to what
    its cell has. No cells give none.
    """
    budget = targets.budget * float(sum(cells.values()))
    weights = {k: targets.budget * float(v) for k, v in sorted(cells.items())}
    for _ in range(targets.rounds if cells else 0):
        for at, axis in enumerate(AXES):
            sums = _sums(weights, at)
            want = _wanted(sums, axis, targets)
            weights = {k: min(float(cells[k]), v * (want[k[at]] * budget / sums[k[at]])) for k, v in weights.items()}
    return weights


def _sums(weights: dict[tuple, float], at: int) -> dict[str, float]:
    sums: dict[str, float] = {}
    for k, v in weights.items():
        sums[k[at]] = sums.get(k[at], 0.0) + v
    return sums


def _wanted(values: dict[str, float], axis: str, targets: Targets) -> dict[str, float]:
    want = {v: share for v, share in targets.of(axis).items() if v in values}
    return {v: share / sum(want.values()) for v, share in want.items()}


def probabilities(cells: dict[tuple, float], targets: Targets) -> dict[tuple, float]:
    """Inclusion probability of the documents of each cell: raked weight over tokens present."""
    raked = rake(cells, targets)
    return {k: raked[k] / cells[k] for k in cells}


def residuals(cells: dict[tuple, float], targets: Targets) -> list[tuple[str, str, float, float, float]]:
    """(axis, value, target, expected, residual) of the marginals: shares of the budget, expected ones as the probabilities give."""
    weights = rake(cells, targets)
    budget = targets.budget * float(sum(cells.values()))
    out = []
    for at, axis in enumerate(AXES):
        sums = _sums(weights, at)
        want = _wanted(sums, axis, targets)
        out += [(axis, v, want[v], sums[v] / budget, sums[v] / budget - want[v]) for v in sorted(sums)]
    return out


def marginals(docs: DataFrame, targets: Targets | None = None) -> DataFrame:
    """(axis, value, target, expected, residual): what the sample's marginals will be, by expected tokens, beside their targets."""
    targets = targets or Targets()
    rows = residuals(_cells(with_cells(docs, targets)), targets)
    return docs.sparkSession.createDataFrame(rows, "axis string, value string, target double, expected double, residual double")


def _cells(of: DataFrame) -> dict[tuple, float]:
    counted = of.groupBy("__mix_source", "__mix_lang", "__mix_topic").agg(F.sum("__mix_tokens").alias("n")).collect()  # bounded by the targets
    return {(r[0], r[1], r[2]): r["n"] for r in counted}


def uniform(doc_id: Column, seed: int) -> Column:
    """A fixed uniform number in [0, 1) for each document, from MD5, which other engines have too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(str(seed))).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def _with_probability(docs: DataFrame, targets: Targets) -> DataFrame:
    of = with_cells(docs, targets)
    p = probabilities(_cells(of), targets)
    table = docs.sparkSession.createDataFrame([(*k, v) for k, v in sorted(p.items())], "__mix_source string, __mix_lang string, __mix_topic string, __mix_p double")
    return of.join(F.broadcast(table), ["__mix_source", "__mix_lang", "__mix_topic"], "left").withColumn("__mix_kept", uniform(F.col("doc_id"), targets.seed) < F.col("__mix_p"))


def calibrate(docs: DataFrame, targets: Targets | None = None) -> DataFrame:
    """(doc_id, source_cell, lang_cell, topic_cell, n_tokens, probability, kept) for every row; an empty table gives no rows.

    Null and empty texts weigh one token. Null sources, languages and topics fall into "other". Rows that share a doc_id, or
    have none, share their random number, and so are kept or dropped together within a cell.
    """
    targets = targets or Targets()
    own = ["doc_id", "text", "source", "lang", *([targets.topic_column] if targets.topic_column else [])]
    out = _with_probability(docs.select(*own), targets)
    return out.select("doc_id", F.col("__mix_source").alias("source_cell"), F.col("__mix_lang").alias("lang_cell"), F.col("__mix_topic").alias("topic_cell"), F.col("__mix_tokens").alias("n_tokens"), F.col("__mix_p").alias("probability"), F.col("__mix_kept").alias("kept"))


def mix(docs: DataFrame, targets: Targets | None = None) -> DataFrame:
    """The sampled rows of docs, with its columns: those that calibrate() keeps. Names that begin with __mix_ are set aside for it."""
    return _with_probability(docs, targets or Targets()).where("__mix_kept").select(*docs.columns)


def sql(docs: str = "documents", targets: Targets | None = None) -> str:
    """The same for DuckDB, as a list of WITH clauses that ends in a table "mixed" of all rows with probability and kept."""
    t = targets or Targets()

    def pick(column: str, values: dict[str, float]) -> str:
        return f"CASE WHEN {column} IN ({', '.join(repr(v) for v in values)}) THEN {column} ELSE '{OTHER}' END"

    topic_sql = "CASE WHEN contains(coalesce(text, ''), 'Licensed under') OR contains(coalesce(text, ''), 'All rights reserved') THEN 'legal' WHEN contains(coalesce(text, ''), ' | ') THEN 'listing' WHEN contains(coalesce(text, ''), '@') OR contains(coalesce(text, ''), 'http') THEN 'contact' ELSE 'prose' END"
    out = [
        f"celled AS (SELECT *, {pick('source', t.source)} AS c_source, {pick('lang', t.lang)} AS c_lang, {topic_sql} AS c_topic, greatest(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 1) AS c_tokens FROM {docs})",
        "cells AS (SELECT c_source, c_lang, c_topic, CAST(sum(c_tokens) AS DOUBLE) AS n FROM celled GROUP BY ALL)",
        f"rake0 AS (SELECT *, CAST({t.budget!r} AS DOUBLE) * n AS w FROM cells)",
    ]
    for axis in AXES:
        rows = ", ".join(f"('{v}', CAST({share!r} AS DOUBLE))" for v, share in t.of(axis).items())
        out.append(f"want_{axis} AS (SELECT v, share / sum(share) OVER () AS share FROM (VALUES {rows}) AS x(v, share) WHERE v IN (SELECT c_{axis} FROM cells))")
    k = 0
    for _ in range(t.rounds):
        for axis in AXES:
            share = f"x.share * (CAST({t.budget!r} AS DOUBLE) * (SELECT sum(n) FROM cells)) / sum(w) OVER (PARTITION BY c_{axis})"
            out.append(f"rake{k + 1} AS MATERIALIZED (SELECT c_source, c_lang, c_topic, n, least(n, w * ({share})) AS w FROM rake{k} JOIN want_{axis} x ON x.v = c_{axis})")
            k += 1
    out.append(f"chances AS (SELECT c_source, c_lang, c_topic, w / n AS p FROM rake{k})")
    out.append(f"mixed AS (SELECT celled.*, p AS probability, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{t.seed}'), 1, 12)) AS BIGINT) / CAST({1 << 48} AS DOUBLE) < p AS kept FROM celled JOIN chances USING (c_source, c_lang, c_topic))")
    return ", ".join(out)
