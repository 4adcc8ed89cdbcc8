"""The reference among several tracks of an episode: order of streams, agreement of all pairs, and the choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervane import config as C
from intervane.operators import correlate as X
from intervane.operators import intervals as I
from intervane.tables import save

# Marks of annotation tracks; text codecs.
ANNOTATIONS = ("sign", "song", "s&s", "lyric", "karaoke", "credit", "commentary", "forced")
TEXT_CODECS = ("subrip", "srt", "ass", "ssa", "mov_text", "text", "webvtt")

# Fixed value: how far two tracks may lie apart and agree (seconds).
AGREEMENT = 0.15


def stream_order(streams: DataFrame, key: str, limit: int = C.MAX_TRACKS) -> DataFrame:
    """Text before image streams, annotations last, defaults first; the first limit. streams: codec, title, forced, is_default, stream."""
    text = F.lower("codec").isin(*TEXT_CODECS)
    noted = F.coalesce(F.col("forced"), F.lit(False))
    for m in ANNOTATIONS:
        noted = noted | F.coalesce(F.lower("title").contains(m), F.lit(False))
    w = Window.partitionBy(key).orderBy(F.desc(text), noted, F.desc("is_default"), "stream")
    return streams.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def audio_stream(streams: DataFrame, key: str) -> DataFrame:
    """Japanese, else default, else first: (key, stream)."""
    rank = F.when(F.lower("language") == "jpn", 0).when(F.col("is_default"), 1).otherwise(2)
    return streams.groupBy(key).agg(F.min_by("stream", F.struct(rank, "stream")).alias("stream"))


def agreement(cues: DataFrame, key: str, track: str, tolerance: float = AGREEMENT, max_search: float = 30.0) -> DataFrame:
    """(key, track, n_cues, agreed, chosen): with how many other tracks of its key the onsets agree within tolerance; the most agreed, then the fullest, then the first is chosen.

    cues: (key, track, src_ix, start, stop), of a few tracks each. All pairs i < j, by one self-join on the key.
    """
    tracks = cues.where("stop > start").groupBy(key, track).agg(F.count("*").alias("n_cues"), F.max_by("stop", F.struct("start", "src_ix")).alias("_last"))
    total = tracks.groupBy(key).agg(F.max("_last").alias("_total"))
    n_all = total.select(key, (F.ceil(F.col("_total") * C.BINS) + 2).cast("long").alias("n_bins"))
    two = [key, track]
    n_own = I.lengths(cues, two)
    merged = I.merge(I.onset_bins(cues.where("stop > start")), two)
    as_ref = I.clip(merged.join(n_all, key), F.col("n_bins")).drop("n_bins")
    as_probe = I.clip(merged.join(n_own, two), F.col("n_bins")).drop("n_bins")
    pairs = tracks.select(key, F.col(track).alias("_i")).join(tracks.select(key, F.col(track).alias("_j")), key).where("_i < _j")
    ref = as_ref.withColumnRenamed(track, "_i").join(pairs, [key, "_i"])
    probe = as_probe.withColumnRenamed(track, "_j").join(pairs, [key, "_j"])
    keys = [key, "_i", "_j"]
    fit = X.correlate(ref.select(*keys, "s", "e"), probe.select(*keys, "s", "e"), pairs.join(n_all, key).select(*keys, "n_bins"), pairs.join(n_own.withColumnRenamed(track, "_j"), [key, "_j"]).select(*keys, "n_bins"), keys, max_search)
    agree = fit.where(F.abs("lag") <= round(tolerance * C.BINS))
    votes = agree.select(key, F.col("_i").alias(track)).unionAll(agree.select(key, F.col("_j").alias(track))).groupBy(*two).agg(F.count("*").alias("agreed"))
    x = tracks.drop("_last").join(votes, two, "left").fillna(0, ["agreed"])
    w = Window.partitionBy(key).orderBy(F.desc("agreed"), F.desc("n_cues"), track)
    return x.withColumn("chosen", F.row_number().over(w) == 1)


def reference(cues: DataFrame, key: str, track: str, runtime=None) -> DataFrame:
    """Agreement among the tracks that pass the quality gates, after dedup. These tracks are read many times and so written first."""
    ok = I.quality_gates(cues, [key, track], runtime).where("gate = 'ok'").select(key, track)
    return agreement(save(I.dedup(cues.join(ok, [key, track], "left_semi"), [key, track]), "reference-tracks"), key, track)


def first_of(preferred: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Rows of preferred, and those of fallback for keys that it lacks. Persist the result to use it more than once."""
    return preferred.unionByName(fallback.join(preferred.select(key).distinct(), key, "left_anti"))
