"""Interval tracks as rows: bins, merging, energy, duty, medians, rates and quality gates.

A cue row has key columns, start and stop in seconds and src_ix, its place in the source. Signals are kept as merged
half-open integer intervals (s, e) at 100 bins a second; dense bins are never made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervane import config as C
from intervane.functions.rounding import half_even


def ordered(cues: DataFrame, keys: list[str]) -> DataFrame:
    """Cues with stop > start, numbered from 0 in stable order of start as cue_ix."""
    w = Window.partitionBy(*keys).orderBy("start", "src_ix")
    return cues.where("stop > start").withColumn("cue_ix", F.row_number().over(w) - 1)


def presence_bins(cues: DataFrame, scale=1.0, max_cue: float = C.MAX_CUE) -> DataFrame:
    """Adds bins (s, e): cues cut at max_cue seconds, at least one bin long."""
    scale = F.lit(scale) if isinstance(scale, (int, float)) else scale
    start = F.col("start") * scale
    stop = F.least(F.col("stop") * scale, start + max_cue)
    s = half_even(start * C.BINS).cast("long")
    return cues.withColumn("s", s).withColumn("e", F.greatest(half_even(stop * C.BINS).cast("long"), F.col("s") + 1))


def onset_bins(cues: DataFrame, scale=1.0, pulse: float = C.PULSE) -> DataFrame:
    """Adds bins (s, e) of a fixed pulse at each start."""
    scale = F.lit(scale) if isinstance(scale, (int, float)) else scale
    return cues.withColumn("s", half_even(F.col("start") * scale * C.BINS).cast("long")).withColumn("e", F.col("s") + max(1, round(pulse * C.BINS)))


def lengths(cues: DataFrame, keys: list[str], scale=1.0) -> DataFrame:
    """(keys, n_bins): ceil of the end of the last-starting cue, plus two."""
    scale = F.lit(scale) if isinstance(scale, (int, float)) else scale
    last = F.max_by(F.col("stop") * scale, F.struct("start", "src_ix"))
    return cues.where("stop > start").groupBy(*keys).agg((F.ceil(last * C.BINS) + 2).cast("long").alias("n_bins"))


def merge(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint intervals (keys, s, e) with the same union as bins; touching ones join.

    One sort: an interval begins where nothing reaches, and ends at what is reached before the next begins, or at the last end.
    """
    w = Window.partitionBy(*keys).orderBy("s", "e")
    x = bins.select(*keys, "s", "e").withColumn("_reach", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("_last", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    first = x.where(F.col("_reach").isNull() | (F.col("s") > F.col("_reach")))
    return first.select(*keys, "s", F.coalesce(F.lead("_reach").over(w), "_last").alias("e"))


def clip(intervals: DataFrame, n_bins) -> DataFrame:
    """Intervals cut to [0, n_bins)."""
    return intervals.withColumn("s", F.greatest("s", F.lit(0))).withColumn("e", F.least(F.col("e"), n_bins)).where("e > s")


def energy(merged: DataFrame, keys: list[str]) -> DataFrame:
    return merged.groupBy(*keys).agg(F.sum(F.col("e") - F.col("s")).alias("energy"), F.count("*").alias("n_intervals"))


def from_probabilities(frames: DataFrame, keys: list[str], frame_seconds: float, threshold: float = 0.5) -> DataFrame:
    """Active bins (keys, bin) of frame scores (frame_no, score): each bin takes the frame it falls in."""
    per = int(1 / (C.BINS * frame_seconds)) + 2
    first = F.ceil(F.col("frame_no") * frame_seconds * C.BINS - 1e-9).cast("long")
    spread = F.explode(F.sequence(first - 1, first + F.lit(int(frame_seconds * C.BINS) + per)))
    bins = frames.where(F.col("score") >= threshold).select(*keys, "frame_no", spread.alias("bin"))
    return bins.where((F.col("bin") >= 0) & (F.floor(F.col("bin") * (1.0 / C.BINS) / frame_seconds) == F.col("frame_no"))).select(*keys, "bin")


def duty_union(cues: DataFrame, keys: list[str], runtime=None) -> DataFrame:
    """(keys, duty): covered time over the runtime (or the track's own span), at most 1; 0 for a minute or less.

    runtime: a column of cues in seconds, or None.
    """
    own = F.max_by("stop", F.struct("start", "src_ix")) - F.min("start")
    spans = cues.where("stop > start").groupBy(*keys).agg((F.max(runtime) if runtime is not None else own).alias("seconds"))
    w = Window.partitionBy(*keys).orderBy("start", "src_ix").rowsBetween(Window.unboundedPreceding, -1)
    fresh = cues.where("stop > start").withColumn("_from", F.greatest("start", F.coalesce(F.max("stop").over(w), F.col("start"))))
    covered = fresh.groupBy(*keys).agg(F.sum(F.greatest(F.col("stop") - F.col("_from"), F.lit(0.0))).alias("covered"))
    return covered.join(spans, keys).select(*keys, F.when(F.col("seconds") > 60, F.least(F.col("covered") / F.col("seconds"), F.lit(1.0))).otherwise(0.0).alias("duty"))


def duty_sum(cues: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, duty): sum of durations over the track's own span, overlaps counted twice, at most 1."""
    span = F.max_by("stop", F.struct("start", "src_ix")) - F.min("start")
    duty = F.least(F.sum(F.col("stop") - F.col("start")) / span, F.lit(1.0))
    return cues.where("stop > start").groupBy(*keys).agg(F.when(span > 0, duty).otherwise(0.0).alias("duty"))


def median_upper(cues: DataFrame, keys: list[str], value: str = "duration") -> DataFrame:
    """(keys, median_upper): the element at floor(n/2) of the sorted values, by rank and not by a collected list."""
    w = Window.partitionBy(*keys)
    ranked = cues.withColumn("_r", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2)).select(*keys, F.col(value).alias("median_upper"))


def cues_per_minute(cues: DataFrame, keys: list[str], runtime=None) -> DataFrame:
    own = F.max_by("stop", F.struct("start", "src_ix")) - F.min("start")
    seconds = F.max(runtime) if runtime is not None else own
    return cues.where("stop > start").groupBy(*keys).agg(F.when(seconds > 60, F.count("*") / (seconds / 60.0)).otherwise(0.0).alias("per_minute"))


def dedup(cues: DataFrame, keys: list[str]) -> DataFrame:
    """First cue of each (start, stop) rounded to 10 ms."""
    key = [half_even(F.col(c) * C.BINS).cast("long") for c in ("start", "stop")]
    w = Window.partitionBy(*keys, *key).orderBy("start", "src_ix")
    return cues.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def quality_gates(cues: DataFrame, keys: list[str], runtime=None) -> DataFrame:
    """(keys, n_cues, duty, per_minute, gate) of each track after dedup: first gate that it fails, or "ok"."""
    cues = cues.where("stop > start")
    counts = cues.groupBy(*keys).agg(F.count("*").alias("n_cues"))
    once = dedup(cues, keys)
    t = counts.join(duty_union(once, keys, runtime), keys).join(cues_per_minute(once, keys, runtime), keys)
    gate = F.when(F.col("n_cues") < C.MIN_REFERENCE_CUES, "few").when(F.col("duty") > C.MAX_DUTY, "always on").when(F.col("per_minute") > C.MAX_CUES_PER_MINUTE, "dense").otherwise("ok")
    return t.withColumn("gate", gate)


def sample_ends(cues: DataFrame, keys: list[str], n: int = 4) -> DataFrame:
    """First n and last n cues of each track, none twice; the last n are only those beyond the first n."""
    w = Window.partitionBy(*keys)
    x = cues.withColumn("_a", F.row_number().over(w.orderBy("start", "src_ix"))).withColumn("_n", F.count("*").over(w))
    return x.where((F.col("_a") <= n) | (F.col("_a") > F.greatest(F.lit(n), F.col("_n") - n))).withColumn("part", F.when(F.col("_a") <= n, "first").otherwise("last")).drop("_a", "_n")


def end_segments(cues: DataFrame, keys: list[str], share: float = C.DRIFT_FRACTION) -> DataFrame:
    """Mean start of the first and last int(share * n) cues: (keys, n_segment, front, back)."""
    w = Window.partitionBy(*keys)
    x = cues.withColumn("_a", F.row_number().over(w.orderBy("start", "src_ix"))).withColumn("_n", F.count("*").over(w))
    x = x.withColumn("_k", F.floor(F.col("_n") * share))
    return x.groupBy(*keys).agg(F.max("_k").alias("n_segment"), F.avg(F.when(F.col("_a") <= F.col("_k"), F.col("start"))).alias("front"), F.avg(F.when(F.col("_a") > F.col("_n") - F.col("_k"), F.col("start"))).alias("back"))


def prefix_sums(bins: DataFrame, keys: list[str], value: str = "w") -> DataFrame:
    """Running sum of value up to and with each bin: (.., upto)."""
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return bins.withColumn("upto", F.sum(value).over(w))


_TILE = 4096


def prefix_index(merged: DataFrame, n_bins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tile, before, parts): bins covered before each tile of [0, n_bins), also empty ones, and the intervals within it, in order."""
    tile = lambda x: F.floor(x / _TILE)
    cut = merged.select(*keys, "s", "e", F.explode(F.sequence(tile(F.col("s")), tile(F.col("e") - 1))).alias("tile"))
    cut = cut.select(*keys, "tile", F.struct(F.greatest(F.col("s"), F.col("tile") * _TILE).alias("s"), F.least(F.col("e"), (F.col("tile") + 1) * _TILE).alias("e")).alias("p"))
    within = cut.groupBy(*keys, "tile").agg(F.sort_array(F.collect_list("p")).alias("parts"), F.sum(F.col("p.e") - F.col("p.s")).alias("_n"))  # at most a tile's bins
    every = n_bins.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), tile(F.greatest(F.col("n_bins"), F.lit(0))))).alias("tile"))
    w = Window.partitionBy(*keys).orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    x = every.join(within, [*keys, "tile"], "left")
    return x.select(*keys, "tile", F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("long").alias("before"), "parts")


def range_sums(merged: DataFrame, n_bins: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """ranges (keys, lo, hi, and others) with covered: bins of [lo, hi) that merged covers, the range held to [0, n_bins) first.

    Two lookups in a prefix index by tile, however long a range is. merged: clipped to [0, n_bins). Keys without bins have none
    covered; an empty or turned range covers none; equal rows come back once.
    """
    own = [c for c in ranges.columns if c not in keys]
    held = ranges.join(n_bins, keys, "left")
    clamp = lambda c: F.greatest(F.lit(0).cast("long"), F.least(F.col(c).cast("long"), F.coalesce("n_bins", F.lit(0))))
    ends = F.array(F.struct(F.lit(-1).alias("sign"), clamp("lo").alias("z")), F.struct(F.lit(1).alias("sign"), F.greatest(clamp("lo"), clamp("hi")).alias("z")))
    looks = held.select(*keys, F.struct(*own).alias("_r"), F.explode(ends).alias("_x")).select(*keys, "_r", "_x.sign", "_x.z", F.floor(F.col("_x.z") / _TILE).alias("tile"))
    found = looks.join(prefix_index(merged, n_bins, keys), [*keys, "tile"], "left")
    inside = F.aggregate(F.coalesce("parts", F.array().cast("array<struct<s:bigint,e:bigint>>")), F.lit(0).cast("long"), lambda acc, p: acc + F.greatest(F.lit(0).cast("long"), F.least(p["e"], F.col("z")) - p["s"]))
    value = F.col("sign") * (F.coalesce("before", F.lit(0)) + inside)
    return found.groupBy(*keys, "_r").agg((F.sum(value) / F.count("*") * 2).cast("long").alias("covered")).select(*keys, "_r.*", "covered")
