"""Quality of measured candidates and the bounded preferences among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervane import config as C
from intervane.functions import names as N
from intervane.functions.rounding import half_even_2


def quality(coverage: Column, correlation: Column, ratio: Column, shift: Column, settings: C.Settings = C.DEFAULTS) -> Column:
    """Coverage, then correlation, uniqueness and a small shift as ever finer tie breaks. No coverage counts as none."""
    cover = F.coalesce(coverage, F.lit(1.0 if settings.exact_has_full_coverage else 0.0))
    return half_even_2(cover) + half_even_2(correlation) / 10.0 + F.least(ratio, F.lit(5.0)) / 1000.0 - F.least(F.abs(shift), F.lit(30.0)) / 100000.0


def _order(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(N.language_rank(F.col("language")), F.desc("quality"), F.desc("score"), "file_id")


def ranked(x: DataFrame, keys: list[str]) -> DataFrame:
    """Final place of acceptable candidates: language, quality, score, then file_id."""
    return x.withColumn("place", F.row_number().over(_order(keys)))


def choose(x: DataFrame, keys: list[str], settings: C.Settings = C.DEFAULTS) -> DataFrame:
    """One row of each key: rank 1, unless the first candidate of the same source, then the first of the series' group, is near enough.

    x: ranked() with source_match and preferred. A preference may cost at most its tolerance in quality and never a worse
    language. The series preference does not apply if its first candidate is rank 1, even when the source preference has moved
    away from it (preference_can_win_back puts that right). Adds chosen_by.
    """
    x = x.withColumn("_lang", N.language_rank(F.col("language")))
    row = F.struct("place", "file_id", "quality", "_lang", "source_match")
    g = x.groupBy(*keys).agg(F.min_by(row, "place").alias("top"), F.min(F.when(F.col("source_match"), row)).alias("src"), F.min(F.when(F.col("preferred"), row)).alias("ser"))
    near = lambda a, b, most: b.isNotNull() & (b["_lang"] <= a["_lang"]) & (a["quality"] - b["quality"] <= most)
    first = F.when(~F.col("top.source_match") & near(F.col("top"), F.col("src"), settings.source_tolerance), F.col("src")).otherwise(F.col("top"))
    g = g.withColumn("mid", first)
    can = F.lit(True) if settings.preference_can_win_back else F.col("ser.place") > 1
    last = F.when(can & near(F.col("mid"), F.col("ser"), settings.series_tolerance), F.col("ser")).otherwise(F.col("mid"))
    g = g.withColumn("fin", last)
    by = F.when((F.col("fin.place") == F.col("ser.place")) & (F.col("fin.place") != F.col("mid.place")), "series").when(F.col("mid.place") != F.col("top.place"), "source").otherwise("rank")
    return g.select(*keys, F.col("fin.file_id").alias("file_id"), F.col("fin.place").alias("place"), by.alias("chosen_by"))


def closest_declined(x: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key's declined candidates, the one that correlates best (ties: smallest file_id)."""
    return x.where("verdict = 'Declined'").groupBy(*keys).agg(F.max_by(F.struct("file_id", "correlation"), F.struct("correlation", -F.col("file_id"))).alias("d")).select(*keys, "d.*")
