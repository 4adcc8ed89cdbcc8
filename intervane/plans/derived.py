"""Inputs derived from the supplied tables, once as DataFrames and once as SQL.

tracks: a user's events as cues of a 24-minute episode. probes: the same without error events, shifted by a known amount.
files: line items as candidate files of orders as episodes. log: a user's events as attempts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bins by which a track's probe is late.
SHIFT = "(track_id * 37) % 4001 - 2000"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, src_ix, sb, db, start, stop, event_type): start and stop in seconds, sb and db in bins."""
    e = read(spark, sf_dir, "events")
    sb = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 18000000")
    x = e.select(F.col("user_id").alias("track_id"), F.col("event_id").alias("src_ix"), sb.alias("sb"), (F.round(F.col("value") * 100).cast("long") % 320 + 80).alias("db"), "event_type")
    return x.withColumn("start", F.col("sb") / 100.0).withColumn("stop", (F.col("sb") + F.col("db")) / 100.0)


def probes(of: DataFrame) -> DataFrame:
    late = F.expr(SHIFT)
    return of.where("event_type <> 'error'").withColumn("sb", F.col("sb") + late).withColumn("start", F.col("sb") / 100.0).withColumn("stop", (F.col("sb") + F.col("db")) / 100.0)


TRACKS = "tracks AS (SELECT user_id AS track_id, event_id AS src_ix, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 18000000 AS sb, CAST(round(value * 100) AS BIGINT) % 320 + 80 AS db, event_type, CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 18000000 AS DOUBLE) / 100.0 AS start_s, CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 18000000 + CAST(round(value * 100) AS BIGINT) % 320 + 80 AS DOUBLE) / 100.0 AS stop_s FROM events)"
PROBES = f"probes AS (SELECT track_id, src_ix, sb + ({SHIFT}) AS sb, db, event_type, CAST(sb + ({SHIFT}) AS DOUBLE) / 100.0 AS start_s, CAST(sb + ({SHIFT}) + db AS DOUBLE) / 100.0 AS stop_s FROM tracks WHERE event_type <> 'error')"

_EXT = "CASE l_returnflag WHEN 'A' THEN 'ass' WHEN 'N' THEN 'srt' WHEN 'R' THEN (CASE WHEN l_linestatus = 'F' THEN 'zip' ELSE 'txt' END) ELSE 'rar' END"
_LANG = "CASE l_linenumber WHEN 1 THEN ' [JPN]' WHEN 2 THEN ' [CHS]' WHEN 3 THEN ' [CHS, JPN]' ELSE '' END"
_MADE = "CASE WHEN l_tax > 0.07 THEN ' [whisperai]' ELSE '' END"
_NAME = f"concat('[G', CAST(l_suppkey % 50 AS {{text}}), '] Show - ', lpad(CAST(l_linenumber AS {{text}}), 2, '0'), ' (', CASE WHEN l_quantity > 25 THEN 'BD 1920x1080' ELSE 'WEB 720p' END, ' ', CASE WHEN l_discount > 0.05 THEN 'HEVC FLAC' ELSE 'x264 AAC' END, ')', {_LANG}, {_MADE}, '.', {_EXT})"
_FILES = "SELECT l_orderkey AS episode_id, l_partkey AS entry_id, l_orderkey * 10 + l_linenumber AS file_id, l_linenumber AS number, {name} AS name, CAST(floor(l_extendedprice / 10.0) AS BIGINT) AS size, l_discount, l_tax, l_quantity, l_suppkey FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, max(l_extendedprice) AS l_extendedprice, min(l_discount) AS l_discount, min(l_tax) AS l_tax, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY l_orderkey, l_linenumber)"
FILES = "files AS (" + _FILES.format(name=_NAME.format(text="VARCHAR")) + ")"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode_id, entry_id, file_id, number, name, size, l_discount, l_tax, l_quantity, l_suppkey)."""
    read(spark, sf_dir, "lineitem").createOrReplaceTempView("intervane_lineitem")
    return spark.sql(_FILES.format(name=_NAME.format(text="STRING")).replace("FROM lineitem", "FROM intervane_lineitem"))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with figures as an alignment would give them: verdict, scale, shift, coverage, correlation, ratio, language, score, source_match, preferred."""
    f = files(spark, sf_dir)
    f.createOrReplaceTempView("intervane_files")
    return spark.sql(_MEASURED.replace("FROM files", "FROM intervane_files"))


_MEASURED = """SELECT episode_id, entry_id, file_id, name,
 CASE WHEN l_tax < 0.02 THEN 'Declined' WHEN l_discount < 0.02 THEN 'Exact' WHEN l_discount > 0.09 THEN 'FramerateDrift' ELSE 'ConstantOffset' END AS verdict,
 CASE WHEN l_discount > 0.09 THEN 1.001 ELSE CAST(1.0 AS DOUBLE) END AS scale,
 CASE WHEN l_discount < 0.02 THEN CAST(0.0 AS DOUBLE) ELSE CAST(l_suppkey % 7 AS DOUBLE) / 20.0 + CAST(episode_id % 3 AS DOUBLE) / 4.0 + CAST(file_id % 89 AS DOUBLE) / 71993.0 END AS shift,
 CASE WHEN number = 7 THEN NULL ELSE CAST((file_id * 7) % 1001 AS DOUBLE) / 1000.0 END AS coverage,
 CAST((file_id * 13) % 997 AS DOUBLE) / 1000.0 AS correlation,
 CAST((file_id * 17) % 601 AS DOUBLE) / 100.0 AS ratio,
 CASE number WHEN 1 THEN 'JapaneseOnly' WHEN 3 THEN 'Multilingual' ELSE 'Unknown' END AS language,
 CAST((file_id * 3) % 11 * 5 AS INT) AS score, l_quantity > 30 AS source_match, l_suppkey % 3 = 0 AS preferred FROM files"""
MEASURED = "measured AS (" + _MEASURED + ")"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode_id, seq, ts, status, outcome, group, entry_id, path): purchases applied, other events declined; errors reject."""
    e = read(spark, sf_dir, "events")
    bought = F.col("event_type") == "purchase"
    return e.select(F.col("user_id").alias("episode_id"), F.col("event_id").alias("seq"), "ts", F.when(bought, "Applied").otherwise("Declined").alias("status"), F.when(bought, "success").when(F.col("event_type") == "error", "reject").otherwise("other").alias("outcome"), F.concat(F.lit("G"), (F.floor("value").cast("long") % 3).cast("string")).alias("group"), (F.col("event_id") % 10).alias("entry_id"), F.concat(F.lit("/v/"), F.col("user_id").cast("string"), F.lit("."), (F.col("event_id") % 4).cast("string"), F.lit(".ja.ass")).alias("path"))


LOG = "log AS (SELECT user_id AS episode_id, event_id AS seq, ts, CASE WHEN event_type = 'purchase' THEN 'Applied' ELSE 'Declined' END AS status, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'reject' ELSE 'other' END AS outcome, concat('G', CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR)) AS grp, event_id % 10 AS entry_id, concat('/v/', CAST(user_id AS VARCHAR), '.', CAST(event_id % 4 AS VARCHAR), '.ja.ass') AS path FROM events)"
