"""Candidate files: lookups, rejection, scoring and the order in which they are tried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervane import config as C
from intervane.functions import names as N
from intervane.functions.rounding import bind
from intervane.tables import save


def tvdb_lookups(episodes: DataFrame, mappings: DataFrame) -> DataFrame:
    """All entries an episode may be, best first: (episode columns, anilist_id, entry_episode, rank).

    episodes: tvdb_id, season, episode; mappings: tvdb_id, tvdb_season, tvdb_offset, anilist_id. A row with season -1 (absolute
    numbering) wins alone; else rows of the season whose offset lies below the episode, largest offset first: an as-of join.
    """
    rows = mappings.where("anilist_id is not null").select("tvdb_id", "tvdb_season", "tvdb_offset", "anilist_id")
    absolute = rows.where("tvdb_season = -1").groupBy("tvdb_id").agg(F.min("anilist_id").alias("_abs"))
    own = [c for c in episodes.columns if c != "tvdb_id"]
    x = episodes.join(absolute, "tvdb_id", "left")
    whole = x.where("_abs is not null").select("tvdb_id", *own, F.col("_abs").alias("anilist_id"), F.col("episode").alias("entry_episode"), F.lit(1).alias("rank"))
    m = x.where("_abs is null").join(rows, "tvdb_id").where("(season is null or tvdb_season = season) and tvdb_offset < episode")
    w = Window.partitionBy("tvdb_id", *own).orderBy(F.desc("tvdb_offset"), "anilist_id")
    return whole.unionByName(m.select("tvdb_id", *own, "anilist_id", (F.col("episode") - F.col("tvdb_offset")).alias("entry_episode"), F.row_number().over(w).alias("rank")))


def fallback_chain(options: DataFrame, keys: list[str], unique: list[str], limit: int = C.MAX_LOOKUPS) -> DataFrame:
    """Options of each key in order of (priority, rank): each once by the columns unique, at most limit. Adds place."""
    order = ["priority", "rank"]
    first = options.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, *unique).orderBy(*order))).where("_k = 1").drop("_k")
    w = Window.partitionBy(*keys).orderBy(*order, *unique)
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def first_productive(found: DataFrame, keys: list[str], priority: str = "place") -> DataFrame:
    """Rows of the lowest priority that gave any row, for each key."""
    return found.withColumn("_k", F.dense_rank().over(Window.partitionBy(*keys).orderBy(priority))).where("_k = 1").drop("_k")


def filtered_or_all(files: DataFrame, keys: list[str], matches: str) -> DataFrame:
    """Files that match the server's filter; where none does, all, with filtered_by_server false."""
    any_ = F.bool_or(F.coalesce(F.col(matches), F.lit(False))).over(Window.partitionBy(*keys))
    return files.withColumn("filtered_by_server", any_).where(~F.col("filtered_by_server") | F.coalesce(F.col(matches), F.lit(False)))


def seen_once(files: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key in the given order."""
    return files.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def rejection(files: DataFrame, entry: list[str], allow_archives: bool = True) -> DataFrame:
    """Adds rejection: "none" or the first of seven reasons, for files (entry columns, name, size).

    An archive is not needed if its entry has any plain subtitle that is large enough and not machine-made, even one rejected
    for its language.
    """
    ext, made = N.extension(F.col("name")), N.machine_made(F.col("name"))
    plain = ext.isin(*N.SUBTITLES) & ~made & (F.col("size") >= C.MIN_FILE_SIZE)
    x = files.withColumn("_plain", F.bool_or(plain).over(Window.partitionBy(*entry)))
    archive = ext.isin(*N.ARCHIVES)
    why = (
        F.when(made, "machine")
        .when(N.language(F.col("name")) == "NoJapanese", "no japanese")
        .when(ext.isin(*N.CLOSED_ARCHIVES), "unreadable archive")
        .when(archive & ~F.lit(allow_archives), "archives disabled")
        .when(archive & F.col("_plain"), "archive not needed")
        .when(archive, "none")
        .when(~ext.isin(*N.SUBTITLES), "extension")
        .when(F.col("size") < C.MIN_FILE_SIZE, "too small")
        .otherwise("none")
    )
    return x.withColumn("rejection", why).drop("_plain")


def not_rejected_before(files: DataFrame, rejected: DataFrame, keys: list[str]) -> DataFrame:
    """Anti-join on the keys and the name without case."""
    r = rejected.select(*keys, F.lower("name").alias("_n")).distinct()
    return files.withColumn("_n", F.lower("name")).join(r, [*keys, "_n"], "left_anti").select(*files.columns)


def with_releases(files: DataFrame, names: dict[str, str]) -> DataFrame:
    """files with what N.agree compares of each name column, and the group as it is named, as another column: {"name": "_s"}. files is read twice.

    Many files share a name, or a video, and patterns cost far more than a lookup: each distinct name is taken apart once, and the
    names with their details are written to the shared folder, whose size decides how they are joined.
    """
    every = files.select(F.explode(F.array(*names)).alias("_name")).where("_name is not null").distinct()
    detail = bind(N.release(F.col("_name")), lambda r: N.compared(r).withField("named", r["group"]))
    known = save(every.select("_name", detail.alias("_release")), "names")
    for name, to in names.items():
        files = files.join(known.select(F.col("_name").alias(name), F.col("_release").alias(to)), name, "left")
    return files


def preferred(group: Column, entry_id: Column, p_group: Column, p_entry: Column, votes: Column, min_votes: int = 2) -> Column:
    """Whether a series profile wants a candidate: by its group, or by its entry if it names no group."""
    g = F.trim(F.coalesce(group, F.lit("")))
    hit = F.when(F.length(g) > 0, F.lower(g) == F.lower(F.coalesce(p_group, F.lit("")))).otherwise((p_entry != 0) & (p_entry == entry_id))
    return F.coalesce((votes >= min_votes) & hit, F.lit(False))


def rank(candidates: DataFrame, keys: list[str], limit: int | None = C.DEFAULTS.max_candidates) -> DataFrame:
    """Order of trial: usable, language, preference, score, name without case, then a unique key. Adds place; at most limit of each key.

    candidates: usable, language, preferred (booleans and text), score, name, entry_id, file_id.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("usable"), N.language_rank(F.col("language")), F.desc("preferred"), F.desc("score"), F.lower("name"), "entry_id", "file_id")
    x = candidates.withColumn("place", F.row_number().over(w))
    return x.where(F.col("place") <= limit) if limit else x


def with_profile(candidates: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """candidates with their series' profile (p_group, p_entry, votes); none leaves them NULL. Also fits a history table."""
    return candidates.join(profiles, key, "left")
