"""Coverage of one track's starts by another's, as a bucketed semi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervane import config as C


def near(needles: DataFrame, hay: DataFrame, keys: list[str], tolerance: float = C.COVERAGE_TOLERANCE) -> DataFrame:
    """Rows of needles (keys, t, and others) for which hay (keys, t) has a time within tolerance.

    An equi-join on the key and a bucket as wide as the tolerance; each needle looks into its own and both neighbours. Hay is
    thinned to the lowest and highest time of a bucket first: if any time of a neighbouring bucket is near, its inner end is,
    and a needle's own bucket is all near. So a bucket of many equal times costs one row. Both sides grow with the cues, so neither
    is broadcast, however small its files are.
    """
    bucket = lambda c: F.floor(F.col(c) / tolerance)
    ends = hay.where("t is not null").groupBy(*keys, bucket("t").alias("_b")).agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    look = needles.withColumn("_b", F.explode(F.array(bucket("t") - 1, bucket("t"), bucket("t") + 1)))
    hit = look.join(ends.hint("merge"), [*keys, "_b"]).where((F.abs(F.col("t") - F.col("_lo")) <= tolerance) | (F.abs(F.col("t") - F.col("_hi")) <= tolerance))
    return hit.select(*needles.columns).distinct()


def measure(ref_cues: DataFrame, probe_cues: DataFrame, keys: list[str], total=None, tolerance: float = C.COVERAGE_TOLERANCE) -> DataFrame:
    """(keys, reference_covered, probe_matched, on_screen): shares of starts with a neighbour, and of total time on screen.

    Cues: (keys, src_ix, start, stop), the probe already corrected. total: (keys, total) in seconds, or None for no on_screen.
    """
    starts = lambda d: d.where("stop > start").select(*keys, "src_ix", F.col("start").alias("t"))
    a, b = starts(ref_cues), starts(probe_cues)
    count = lambda d, n: d.groupBy(*keys).agg(F.count("*").alias(n))
    x = count(a, "_a").join(count(b, "_b"), keys).join(count(near(a, b, keys, tolerance), "_c"), keys, "left").join(count(near(b, a, keys, tolerance), "_m"), keys, "left")
    shown = probe_cues.where("stop > start").groupBy(*keys).agg(F.sum(F.col("stop") - F.col("start")).alias("_shown"))
    x = x.join(shown, keys)
    x = x.join(total, keys, "left") if total is not None else x.withColumn("total", F.lit(None).cast("double"))
    share = F.when(F.col("total") > 0, F.least(F.col("_shown") / F.col("total"), F.lit(1.0))).otherwise(0.0)
    return x.select(*keys, (F.coalesce("_c", F.lit(0)) / F.col("_a")).alias("reference_covered"), (F.coalesce("_m", F.lit(0)) / F.col("_b")).alias("probe_matched"), share.alias("on_screen"))
