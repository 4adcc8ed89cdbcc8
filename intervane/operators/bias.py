"""A bias of the reference that most candidates share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervane import config as C
from intervane.functions import timing as T


def consensus(votes: DataFrame, keys: list[str], value: str = "shift") -> DataFrame:
    """(keys, n, agreeing, bias): mean of the votes within the tolerance of the true median, NULL unless enough agree."""
    median = votes.groupBy(*keys).agg(F.median(value).alias("_m"), F.count(value).alias("n"))
    near = F.abs(F.col(value) - F.col("_m")) <= C.BIAS_TOLERANCE
    x = votes.join(median, keys).groupBy(*keys).agg(F.max("n").alias("n"), F.count_if(near).alias("agreeing"), F.avg(F.when(near, F.col(value))).alias("_mean"))
    enough = (F.col("agreeing") >= C.BIAS_MIN) & (F.col("agreeing") / F.col("n") >= C.BIAS_SHARE)
    return x.select(*keys, "n", F.when(F.col("n") >= C.BIAS_MIN, F.col("agreeing")).otherwise(0).alias("agreeing"), F.when(enough, F.col("_mean")).alias("bias"))


def correct(candidates: DataFrame, keys: list[str], settings: C.Settings = C.DEFAULTS) -> DataFrame:
    """candidates (keys, verdict, scale, shift) with the shared bias taken off shift-only ones and their verdict derived again.

    Votes are the shifts of shift-only or declined candidates, zeros of exact ones included. Adds bias (0 if none).
    """
    shifted = T.shift_only(F.col("scale"))
    votes = candidates.where(F.col("verdict").isNotNull() & (shifted | (F.col("verdict") == "Declined")))
    found = consensus(votes, keys).where(F.abs("bias") >= C.BIAS_IGNORED).select(*keys, F.col("bias").alias("_bias"))
    x = candidates.join(found, keys, "left")
    moves = F.col("_bias").isNotNull() & shifted & F.col("verdict").isNotNull()
    if not settings.bias_moves_exact:
        moves = moves & (F.col("verdict") != "Exact")
    x = x.withColumn("bias", F.when(moves, F.col("_bias")).otherwise(0.0)).withColumn("_new", F.col("shift") - F.col("bias"))
    judged = moves & F.col("verdict").isin("Exact", "ConstantOffset")
    small = F.abs("_new") < settings.min_correction
    x = x.withColumn("verdict", F.when(judged & small, "Exact").when(judged, "ConstantOffset").otherwise(F.col("verdict")))
    x = x.withColumn("scale", F.when(judged & small, 1.0).otherwise(F.col("scale")))
    return x.withColumn("shift", F.when(judged & small, 0.0).otherwise(F.col("_new"))).drop("_bias", "_new")
