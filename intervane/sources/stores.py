"""Tables beside the subtitle documents: id mappings, archives, listings, keyed stores, sidecars and logs."""

from __future__ import annotations

import io
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intervane.functions import names as N

_FIELDS = ("tvdb_id", "tvdb_season", "tvdb_epoffset", "anilist_id")


def id_mappings(text: DataFrame, column: str = "value") -> DataFrame:
    """(anidb_id, tvdb_id, tvdb_season, tvdb_offset, anilist_id) of a JSON object keyed by id; values that are no number are NULL, a missing offset 0."""
    one = "map<string,struct<" + ",".join(f"{f}:string" for f in _FIELDS) + ">>"
    rows = text.select(F.explode(F.from_json(column, one)).alias("k", "v"))
    n = lambda f: N.lenient_int(F.col(f"v.{f}"))
    return rows.select(F.col("k").try_cast("int").alias("anidb_id"), n("tvdb_id").alias("tvdb_id"), n("tvdb_season").alias("tvdb_season"), F.coalesce(n("tvdb_epoffset"), F.lit(0)).alias("tvdb_offset"), n("anilist_id").alias("anilist_id")).where("anidb_id is not null")


def archive_members(files: DataFrame) -> DataFrame:
    """(path, member, content, place) of the files in ZIP archives (path, content binary), place being their order.

    What is no archive gives no rows, nor does a member that is empty, encrypted, damaged or packed in an unknown way.
    """

    def run(batches):
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame(list(_members(path, bytes(raw or b""))), columns=["path", "member", "content", "place"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, content binary, place int")


def _members(path: str, raw: bytes):
    try:
        archive = zipfile.ZipFile(io.BytesIO(raw))
    except (zipfile.BadZipFile, NotImplementedError, ValueError):
        return
    with archive:
        for place, m in enumerate(archive.infolist()):
            if m.is_dir() or not m.file_size:
                continue
            try:
                yield path, m.filename, archive.read(m), place
            except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError):
                continue


def choose_member(members: DataFrame, episode: Column, key: str = "path") -> DataFrame:
    """One subtitle of each archive: the first in it of the episode, else the only one."""
    m = members.where(N.extension(F.col("member")).isin(*N.SUBTITLES)).withColumn("_ep", N.release(F.col("member"))["episode"])
    w = Window.partitionBy(key)
    hit = F.coalesce(F.col("_ep") == episode, F.lit(False))
    ranked = m.withColumn("_hit", hit).withColumn("_n", F.count("*").over(w))
    ranked = ranked.withColumn("_k", F.row_number().over(w.orderBy(F.desc("_hit"), "place")))
    return ranked.where("_k = 1 and (_hit or _n = 1)").drop("_hit", "_n", "_k", "_ep")


def library(items: DataFrame, conditions: Column, limit: int = 250) -> DataFrame:
    """Items that meet the conditions, newest first, at most limit."""
    return items.where(conditions).orderBy(F.desc("added"), "item_id").limit(limit)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified) of all files below path; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def sidecars(files: DataFrame, base: Column, tag: Column) -> DataFrame:
    return files.where(N.looks_like_ours(F.col("path"), base, tag))


def free_names(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """wanted (base, tag, ext) with path: the plain name, else the first of base.1. to base.99. that no existing path has, else the plain one."""
    plain = F.concat_ws(".", "base", F.lower("tag"), F.lower("ext"))
    numbered = F.concat_ws(".", "base", F.col("n").cast("string"), F.lower("tag"), F.lower("ext"))
    tries = wanted.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("path", F.when(F.col("n") == 0, plain).otherwise(numbered))
    free = tries.join(existing.select("path").distinct(), "path", "left_anti")
    best = free.groupBy("base", "tag", "ext").agg(F.min_by("path", "n").alias("path"))
    return wanted.join(best, ["base", "tag", "ext"], "left").withColumn("path", F.coalesce("path", plain))


def owned(recorded: DataFrame, stamped: DataFrame) -> DataFrame:
    """Paths that are ours: recorded ones and those that carry a stamp, each once."""
    return recorded.select("path").union(stamped.select("path")).distinct()


def log_rows(results: DataFrame) -> DataFrame:
    """Activity rows (item_id, at, severity, message) of results (item_id, at, verdict, file_name, reason)."""
    good = F.col("verdict") != "Declined"
    return results.select("item_id", "at", F.when(good, "info").otherwise("warning").alias("severity"), F.when(good, F.concat_ws(" ", F.lit("attached"), "file_name")).otherwise(F.concat_ws(" ", F.lit("declined:"), "reason")).alias("message"))
