"""Queries on caches of references, profiles, gates and range sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from intervane.functions import ass as A
from intervane.operators import align as AL
from intervane.operators import candidates as CA
from intervane.operators import history as H
from intervane.operators import intervals as I
from intervane.operators import resolve as RE
from intervane.operators import vad as V
from intervane.plans.derived import FILES, LOG, MEASURED, PROBES, TRACKS, log, measured, probes, read, tracks
from intervane.plans.past import FOLD
from intervane.plans.registry import query
from intervane.plans.signals import KEY, bins_sql, clip_sql, length_sql, merge_sql
from intervane.sources.keyed import KeyedStore
from intervane.tables import new_folder

_LOOKUPS = "r AS (SELECT user_id % 5 AS cache, event_id AS seq, CAST(floor(value) AS BIGINT) % 23 AS item, concat('/m/', CAST(CAST(floor(value) AS BIGINT) % 23 AS VARCHAR)) AS path, event_id // 300 AS stamp, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS n FROM events)"
_KEPT = "STRUCT(item BIGINT, path VARCHAR, stamp BIGINT)[]"
_CACHE = f"""f AS (SELECT DISTINCT cache, 0::BIGINT AS n, []::{_KEPT} AS kept, ''::VARCHAR AS answered, NULL::BIGINT AS evicted, NULL::BIGINT AS seq, NULL::BIGINT AS item, NULL::BIGINT AS stamp FROM r UNION ALL
 SELECT cache, n, CASE WHEN hit THEN kept WHEN len(grown) > {RE.MOST} THEN grown[2:] ELSE grown END, CASE WHEN hit THEN 'hit' WHEN known THEN 'stale' ELSE 'new' END, CASE WHEN NOT hit AND len(grown) > {RE.MOST} THEN grown[1].item END, seq, item, stamp FROM (
  SELECT *, list_contains(kept, me) AS hit, len(list_filter(kept, lambda x: x.item = item)) > 0 AS known, list_append(list_filter(kept, lambda x: x.item <> item), me) AS grown FROM (
   SELECT f.cache, r.n, f.kept, r.seq, r.item, r.stamp, {{'item': r.item, 'path': r.path, 'stamp': r.stamp}} AS me FROM f JOIN r ON r.cache = f.cache AND r.n = f.n + 1)))"""


@query(f"""WITH RECURSIVE {_LOOKUPS}, {_CACHE} SELECT cache, seq, item, answered, evicted,
CASE WHEN (item + stamp) % 3 = 0 THEN 'embedded' WHEN (item + stamp) % 3 = 1 THEN 'sound' ELSE 'none' END AS source FROM f WHERE n > 0""")
def reference_cache(spark, sf_dir):
    """Events as lookups of 23 items by five caches; what an item is stamped with changes every 300 events."""
    e = read(spark, sf_dir, "events")
    item = F.floor("value").cast("long") % 23
    r = e.select((F.col("user_id") % 5).alias("cache"), F.col("event_id").alias("seq"), item.alias("item"), F.concat(F.lit("/m/"), item.cast("string")).alias("path"), F.expr("event_id div 300").alias("stamp"))
    of = lambda k: r.where((F.col("item") + F.col("stamp")) % 3 == k)
    return RE.built(RE.lookups(r, "cache"), of(0), of(1)).select("cache", "seq", "item", "answered", "evicted", "source")


_RANGES = "ranges AS (SELECT track_id, src_ix, sb - 400 AS lo, sb + CASE WHEN src_ix % 10 = 0 THEN 50000 ELSE db + 400 END AS hi FROM probes)"


@query(f"""WITH {TRACKS}, {PROBES}, na AS ({length_sql('tracks')}), ra AS ({clip_sql(merge_sql(bins_sql('tracks')), 'SELECT * FROM na')}), {_RANGES}
SELECT x.track_id, x.src_ix, CAST(coalesce(sum(CASE WHEN s_s IS NOT NULL THEN least(s_e, z) - greatest(s_s, a) END), 0) AS BIGINT) AS covered FROM (SELECT r.*, greatest(lo, 0) AS a, least(hi, n_bins) AS z FROM ranges r JOIN na USING (track_id)) x
LEFT JOIN (SELECT track_id, s AS s_s, e AS s_e FROM ra) i ON i.track_id = x.track_id AND s_s < z AND s_e > a GROUP BY x.track_id, x.src_ix""")
def clamped_range_sums(spark, sf_dir):
    """Bins of each track that a widened probe cue covers, also beyond its ends; every tenth range is 500 s long."""
    a = tracks(spark, sf_dir)
    n = I.lengths(a, KEY)
    merged = I.clip(I.merge(I.presence_bins(a.where("stop > start")), KEY).join(n, KEY), F.col("n_bins")).drop("n_bins")
    r = probes(a).select("track_id", "src_ix", (F.col("sb") - 400).alias("lo"), (F.col("sb") + F.when(F.col("src_ix") % 10 == 0, 50_000).otherwise(F.col("db") + 400)).alias("hi"))
    return I.range_sums(merged, n, r, KEY).select("track_id", "src_ix", "covered")


@query("""WITH f AS (SELECT event_type AS kind, CASE event_type WHEN 'view' THEN 0.99 WHEN 'error' THEN CAST(event_id % 100 AS DOUBLE) / 198.0 ELSE CAST(event_id * 37 % 100 AS DOUBLE) / 100.0 END AS score FROM events)
SELECT kind, count(*) AS n_frames, round(avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END), 9) AS duty, count(*) >= 100 AND avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) BETWEEN 0.02 AND 0.95 AS usable FROM f GROUP BY kind""")
def vad_usable(spark, sf_dir):
    """Tracks of scores by type of event: one always active, one nearly silent."""
    kind = F.col("event_type")
    score = F.when(kind == "view", 0.99).when(kind == "error", (F.col("event_id") % 100) / 198.0).otherwise((F.col("event_id") * 37 % 100) / 100.0)
    x = V.usable(read(spark, sf_dir, "events").select(kind.alias("kind"), score.alias("score")), "kind")
    return x.withColumn("duty", F.round("duty", 9))


@query(f"""WITH RECURSIVE {FILES}, {MEASURED}, {LOG}, {FOLD}, prof AS (SELECT episode_id, arg_max(g, n) AS p_group, arg_max(e, n) AS p_entry, arg_max(v, n) AS votes FROM fold GROUP BY episode_id),
c AS (SELECT m.file_id, m.episode_id % 200 AS key, concat('G', CAST(file_id % 4 AS VARCHAR)) AS grp, file_id % 10 AS entry FROM measured m WHERE verdict IN ('Exact', 'ConstantOffset', 'FramerateDrift', 'PiecewiseCut'))
SELECT c.file_id, p.votes, coalesce(p.votes >= 2 AND CASE WHEN c.file_id % 3 > 0 THEN lower(grp) = lower(p.p_group) ELSE p.p_entry <> 0 AND p.p_entry = entry END, FALSE) AS preferred FROM c LEFT JOIN prof p ON p.episode_id = c.key""")
def profile_preference(spark, sf_dir):
    """Acceptable files with the profile that a user's attempts made; every third file names no group and goes by its entry."""
    profiles = H.vote(log(spark, sf_dir), "episode_id").withColumnRenamed("episode_id", "key")
    f = measured(spark, sf_dir).where(AL.is_acceptable(F.col("verdict"))).select("file_id", (F.col("episode_id") % 200).alias("key"), (F.col("file_id") % 10).alias("entry"))
    group = F.when(F.col("file_id") % 3 > 0, F.concat(F.lit("G"), (F.col("file_id") % 4).cast("string")))
    x = CA.with_profile(f, profiles, "key")
    return x.select("file_id", "votes", CA.preferred(group, F.col("entry"), F.col("p_group"), F.col("p_entry"), F.col("votes")).alias("preferred"))


@query(f"""WITH {LOG}, l AS (SELECT episode_id, max(seq) AS seq, arg_max(status, seq) AS status, count(*) AS n FROM log GROUP BY episode_id)
SELECT episode_id, CASE WHEN episode_id % 2 = 0 THEN least(n, 20) ELSE 1 END AS n_attempts, seq AS last_seq, status AS last_status FROM l""")
def attempts_backfill(spark, sf_dir):
    """Rows with a log of attempts where the user is even, and from before logs were kept where odd."""
    of = log(spark, sf_dir)
    logs = H.statuses(of, "episode_id").where("episode_id % 2 = 0").groupBy("episode_id").agg(F.sort_array(F.collect_list(F.struct("seq", "status"))).alias("attempts"))
    rows = H.backfill(H.latest(of, "episode_id").select("episode_id", "seq", "status").join(logs, "episode_id", "left"))
    last = F.element_at("attempts", -1)
    return rows.select("episode_id", F.size("attempts").cast("long").alias("n_attempts"), last["seq"].alias("last_seq"), last["status"].alias("last_status"))


_BLOCKED = "concat('{\\\\k', CAST(p_size AS VARCHAR), '}', p_name, '{', p_type, '} ', p_brand, CASE WHEN p_partkey % 5 = 0 THEN '{open' ELSE '' END)"


@query("SELECT p_partkey AS k, concat(p_name, ' ', p_brand) AS plain FROM part")
def strip_override_blocks(spark, sf_dir):
    """Names with blocks of tags in and after them; every fifth one is never closed."""
    p = read(spark, sf_dir, "part")
    p.createOrReplaceTempView("intervane_part")
    x = spark.sql(f"SELECT p_partkey AS k, {_BLOCKED.replace('VARCHAR', 'STRING')} AS text FROM intervane_part")
    return x.select("k", A.strip_blocks(F.col("text")).alias("plain"))


@query(f"""WITH {LOG}, l AS (SELECT episode_id, seq % 3 AS part, max(seq) AS seq, arg_max(status, seq) AS status FROM log GROUP BY ALL)
SELECT episode_id, status, seq FROM l WHERE CASE WHEN episode_id % 5 = 0 AND part = 2 THEN 3 WHEN episode_id % 7 = 0 OR part = 2 THEN 0 WHEN part = 1 THEN 2 ELSE 1 END > 0
QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY CASE WHEN part = 2 THEN 3 WHEN part = 1 THEN 2 ELSE 1 END DESC) = 1""")
def keyed_store(spark, sf_dir):
    """The newest attempts of thirds of the log, put one after the other, with every seventh user cleared and the store compacted before the last."""
    of = log(spark, sf_dir)
    part = lambda k: H.latest(of.where(F.col("seq") % 3 == k), "episode_id")
    store = KeyedStore(spark, new_folder(spark, "store"), "episode_id long, status string, seq long", ("episode_id",), 8)
    store.put(part(0))
    store.put(part(1))
    store.clear(of.where("episode_id % 7 = 0"))
    store.compact()
    store.put(part(2).where("episode_id % 5 = 0"))
    return store.get()
