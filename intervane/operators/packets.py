"""Cues from packet timings, as window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Smallest packet that shows something (bytes), longest and nominal inferred durations, share that must have durations, least duration (seconds).
MIN_BYTES, MAX_INFERRED, NOMINAL, TRUSTED_SHARE, MIN_DURATION = 48, 10.0, 2.0, 0.5, 0.05


def parse(lines: DataFrame, keys: list[str], column: str = "line") -> DataFrame:
    """(keys, src_ix, stream, pts, duration, size) of CSV lines stream,pts,duration,size; lines without a stream number or a time are left out."""
    f = F.split(F.col(column), ",")
    get = lambda k: F.try_element_at(f, F.lit(k))
    x = lines.select(*keys, "src_ix", get(1).try_cast("int").alias("stream"), get(2).try_cast("double").alias("pts"), F.coalesce(get(3).try_cast("double"), F.lit(0.0)).alias("duration"), F.coalesce(get(4).try_cast("int"), F.lit(0)).alias("size"), F.size(f).alias("_n"))
    return x.where("stream is not null and pts >= 0 and _n >= 4").drop("_n")


def cues(packets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src_ix, start, stop) of packets (keys, src_ix, pts, duration, size), in order of src_ix.

    A small packet erases: it ends the cue before it if that has no duration, the first such packet counting. Other missing
    durations last to the next cue, at most 10 s, or nominally 2 s if fewer than half of the cues have one.
    """
    w = Window.partitionBy(*keys).orderBy("src_ix")
    erase = (F.col("size") > 0) & (F.col("size") < MIN_BYTES)
    x = packets.withColumn("_erase", erase).withColumn("_cue", F.sum((~erase).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    of_cue = Window.partitionBy(*keys, "_cue").orderBy("src_ix")
    gap = of_cue.rowsBetween(1, Window.unboundedFollowing)
    x = x.withColumn("_start", F.first("pts").over(of_cue))
    # An erase at or before the start leaves the duration at zero, so the next one may still end the cue.
    ends = F.min(F.when(F.col("_erase"), F.struct((F.col("pts") <= F.col("_start")).alias("late"), F.col("src_ix"), F.col("pts")))).over(gap)
    x = x.withColumn("_end", ends).where("_cue > 0 and not _erase")
    closed = F.when(F.col("duration") > 0, F.col("duration")).when(F.col("_end").isNotNull(), F.greatest(F.col("_end.pts") - F.col("pts"), F.lit(0.0))).otherwise(F.col("duration"))
    x = x.withColumn("_d", closed)
    trusted = F.avg((F.col("_d") > 0).cast("double")).over(Window.partitionBy(*keys)) >= TRUSTED_SHARE
    to_next = F.coalesce(F.lead("pts").over(w) - F.col("pts"), F.lit(NOMINAL))
    inferred = F.least(to_next, F.when(trusted, MAX_INFERRED).otherwise(NOMINAL))
    x = x.withColumn("_d", F.when(F.col("_d") > 0, F.col("_d")).otherwise(inferred))
    return x.where(F.col("_d") >= MIN_DURATION).select(*keys, "src_ix", F.col("pts").alias("start"), (F.col("pts") + F.col("_d")).alias("stop"))


def match_streams(library: DataFrame, probed: DataFrame, key: str) -> DataFrame:
    """Library streams (key, stream, ordinal) with the probed one (key, stream, ordinal, n_packets): by number, else by place in order."""
    a = probed.select(key, "stream", F.col("n_packets").alias("_by_ix"))
    b = probed.select(key, "ordinal", F.col("n_packets").alias("_by_ord"))
    x = library.join(a, [key, "stream"], "left").join(b, [key, "ordinal"], "left")
    return x.withColumn("n_packets", F.coalesce("_by_ix", "_by_ord")).drop("_by_ix", "_by_ord")
