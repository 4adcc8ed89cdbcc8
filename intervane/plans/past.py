"""Queries on attempt logs, votes, limits, notes and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from intervane.functions import ass as A
from intervane.functions import timing as T
from intervane.operators import history as H
from intervane.plans.derived import FILES, LOG, MEASURED, TRACKS, log, measured, read, tracks
from intervane.plans.registry import query
from intervane.sources import stores
from intervane.sources import subtitles as SU
from intervane.streaming import state as ST
from intervane.tables import new_folder

_STATUS = "stat AS (SELECT *, CASE WHEN status = 'Applied' AND max(CASE WHEN status = 'Applied' THEN seq END) OVER (PARTITION BY episode_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) IS NOT NULL THEN 'Superseded' ELSE status END AS kept, row_number() OVER (PARTITION BY episode_id ORDER BY seq DESC) AS r FROM log)"


@query(f"WITH {LOG}, {_STATUS} SELECT episode_id, seq, kept AS status FROM stat WHERE r <= 20")
def history_supersede(spark, sf_dir):
    return H.statuses(log(spark, sf_dir), "episode_id").select("episode_id", "seq", "status")


@query(f"WITH {LOG} SELECT episode_id, max(seq) AS seq, arg_max(status, seq) AS status FROM log GROUP BY episode_id")
def history_latest(spark, sf_dir):
    return H.latest(log(spark, sf_dir), "episode_id").select("episode_id", "seq", "status")


@query(f"WITH {LOG}, {_STATUS} SELECT episode_id, seq, CASE WHEN kept = 'Applied' AND episode_id % 2 = 0 THEN 'Rejected' ELSE kept END AS status FROM stat WHERE r <= 20")
def reject_current(spark, sf_dir):
    x = H.statuses(log(spark, sf_dir), "episode_id")
    return H.reject_current(x, x.where("episode_id % 2 = 0"), "episode_id").select("episode_id", "seq", "status")


@query(f"WITH {LOG}, {_STATUS} SELECT DISTINCT episode_id, path FROM stat WHERE kept = 'Applied' AND r <= 20")
def applied_paths(spark, sf_dir):
    return H.applied_paths(H.statuses(log(spark, sf_dir), "episode_id"), "episode_id")


@query(f"WITH {LOG}, {FILES}, {MEASURED} SELECT path FROM log WHERE status = 'Applied' UNION SELECT concat('/v/', CAST(file_id % 50 AS VARCHAR), '.1.ja.ass') FROM measured WHERE verdict = 'Exact'")
def owned_sidecars(spark, sf_dir):
    stamped = measured(spark, sf_dir).where("verdict = 'Exact'").select(F.concat(F.lit("/v/"), (F.col("file_id") % 50).cast("string"), F.lit(".1.ja.ass")).alias("path"))
    return stores.owned(log(spark, sf_dir).where("status = 'Applied'"), stamped)


@query(f"WITH {LOG}, l AS (SELECT episode_id, arg_max(status, seq) AS status, arg_max(ts, seq) AS ts, arg_max(path, seq) AS path FROM log GROUP BY episode_id) SELECT episode_id, CASE WHEN status = 'Applied' THEN path LIKE '%.1.ja.ass' OR path LIKE '%.2.ja.ass' ELSE epoch_us(TIMESTAMP '2024-02-10') - epoch_us(ts) < 14 * CAST(86400000000 AS BIGINT) END AS skip FROM l")
def skip_rule(spark, sf_dir):
    of = log(spark, sf_dir)
    state = H.latest(of, "episode_id").withColumn("verdict", F.when(F.col("status") == "Applied", "Exact").otherwise("Declined")).withColumn("at", F.col("ts"))
    there = of.where("path like '%.1.ja.ass' or path like '%.2.ja.ass'")
    return H.skip(state, F.lit("2024-02-10 00:00:00").cast("timestamp"), there).select("episode_id", "skip")


@query("WITH o AS (SELECT user_id % 40 AS run, CASE event_type WHEN 'purchase' THEN 'applied' WHEN 'error' THEN 'declined' WHEN 'view' THEN 'skipped' ELSE 'waiting' END AS outcome FROM events) SELECT run, count(*) FILTER (WHERE outcome = 'applied') AS applied, count(*) FILTER (WHERE outcome = 'declined') AS declined, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) AS total, round(CAST(count(*) FILTER (WHERE outcome <> 'waiting') AS DOUBLE) / count(*), 9) AS fraction FROM o GROUP BY run")
def sweep_counters(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "applied").when(F.col("event_type") == "error", "declined").when(F.col("event_type") == "view", "skipped").otherwise("waiting")
    x = read(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("run"), kind.alias("outcome"))
    return H.counters(x, ["run"]).withColumn("fraction", F.round("fraction", 9))


FOLD = """num AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY seq) AS n FROM log),
fold AS (SELECT episode_id, CAST(0 AS BIGINT) AS n, '' AS g, CAST(0 AS BIGINT) AS e, 0 AS v FROM (SELECT DISTINCT episode_id FROM log)
UNION ALL SELECT f.episode_id, x.n, CASE WHEN x.outcome = 'success' AND x.grp <> f.g AND f.v <= 1 THEN x.grp WHEN x.outcome = 'reject' AND x.grp = f.g AND f.v <= 1 THEN '' ELSE f.g END,
 CASE WHEN x.outcome = 'success' AND (x.grp = f.g OR f.v <= 1) THEN x.entry_id WHEN x.outcome = 'reject' AND x.grp = f.g AND f.v <= 1 THEN 0 ELSE f.e END,
 CASE WHEN x.outcome = 'success' THEN (CASE WHEN x.grp = f.g THEN least(f.v + 1, 10) WHEN f.v <= 1 THEN 1 ELSE f.v - 1 END) WHEN x.outcome = 'reject' AND x.grp = f.g THEN greatest(f.v - 1, 0) ELSE f.v END
 FROM fold f JOIN num x ON x.episode_id = f.episode_id AND x.n = f.n + 1)"""


@query(f"WITH RECURSIVE {LOG}, {FOLD} SELECT episode_id, arg_max(g, n) AS p_group, arg_max(e, n) AS p_entry, arg_max(v, n) AS votes FROM fold GROUP BY episode_id")
def vote_fold(spark, sf_dir):
    return H.vote(log(spark, sf_dir), "episode_id")


_ADMITTED = """WITH RECURSIVE r AS (SELECT user_id % 8 AS k, event_id AS seq, CAST(event_id * 300 AS BIGINT) AS at_ms, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS n FROM events),
f AS (SELECT k, seq, at_ms, n, at_ms AS t, [at_ms] AS last FROM r WHERE n = 1
UNION ALL SELECT x.k, x.seq, x.at_ms, x.n, x.t, list_append(CASE WHEN len(x.last) >= 5 THEN x.last[2:] ELSE x.last END, x.t) FROM (SELECT r.k, r.seq, r.at_ms, r.n, f.last, CASE WHEN len(f.last) >= 5 AND f.last[1] + 10000 > greatest(r.at_ms, f.t) THEN f.last[1] + 10050 ELSE greatest(r.at_ms, f.t) END AS t FROM f JOIN r ON r.k = f.k AND r.n = f.n + 1) x)
SELECT k, seq, at_ms, t AS admitted_ms FROM f"""


@query(_ADMITTED)
def rate_limiter(spark, sf_dir):
    x = read(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("k"), F.col("event_id").alias("seq"), (F.col("event_id") * 300).alias("at_ms"))
    return H.admit(x, "k", 5, 10_000)


def streamed(spark, sf_dir, make, name: str):
    """Rows that a stateful query over the events table, read as a stream of its file or files, has written to the shared folder by the time it has seen all of it."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events[.]parquet")  # a pattern, as a stream takes no single file
    out = make(stream)
    path, checkpoint = new_folder(spark, name), new_folder(spark, f"{name}-checkpoint")
    out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


@query(_ADMITTED)
def rate_limiter_stream(spark, sf_dir):
    def make(s):
        return ST.admit(s.select((F.col("user_id") % 8).alias("k"), F.col("event_id").alias("seq"), (F.col("event_id") * 300).alias("at_ms")), "k", 5, 10_000)

    return streamed(spark, sf_dir, make, "admitted")


@query(f"WITH {TRACKS} SELECT track_id, src_ix, CAST(floor(c * 25.0::DOUBLE / 24.0::DOUBLE + 0.5) AS BIGINT) - CAST(floor((c - db) * 25.0::DOUBLE / 24.0::DOUBLE + 0.5) AS BIGINT) AS scaled FROM (SELECT *, CAST(sum(db) OVER (PARTITION BY track_id ORDER BY src_ix ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c FROM tracks)")
def cumulative_scale(spark, sf_dir):
    """Karaoke durations scaled as running totals and differenced again."""
    from pyspark.sql import Window

    from intervane.functions.rounding import half_away

    w = Window.partitionBy("track_id").orderBy("src_ix").rowsBetween(Window.unboundedPreceding, 0)
    x = tracks(spark, sf_dir).withColumn("c", F.sum("db").over(w))
    to = lambda c: half_away(c * F.lit(25.0) / F.lit(24.0)).cast("long")
    return x.select("track_id", "src_ix", (to(F.col("c")) - to(F.col("c") - F.col("db"))).alias("scaled"))


def _hms(cs: str, kind: str) -> str:
    if kind == "ass":
        return f"concat(CAST({cs} // 360000 AS VARCHAR), ':', lpad(CAST({cs} // 6000 % 60 AS VARCHAR), 2, '0'), ':', lpad(CAST({cs} // 100 % 60 AS VARCHAR), 2, '0'), '.', lpad(CAST({cs} % 100 AS VARCHAR), 2, '0'))"
    return f"concat(lpad(CAST({cs} // 360000 AS VARCHAR), 2, '0'), ':', lpad(CAST({cs} // 6000 % 60 AS VARCHAR), 2, '0'), ':', lpad(CAST({cs} // 100 % 60 AS VARCHAR), 2, '0'), ',', lpad(CAST({cs} % 100 AS VARCHAR), 2, '0'), '0')"


def documents(spark, sf_dir, kind: str):
    """One document a user, made of its cues in order: (doc_id, content)."""
    t = tracks(spark, sf_dir)
    a, b = T.format_time(F.col("start"), kind), T.format_time(F.col("stop"), kind)
    words = F.when(F.col("event_type") == "error", "♪ ~").otherwise(F.concat(F.lit("{\\i1}line, "), F.col("src_ix").cast("string")))
    if kind == "ass":
        line = F.concat(F.when(F.col("event_type") == "click", "Comment: 0,").otherwise("Dialogue: 0,"), a, F.lit(","), b, F.lit(",Main,,0,0,0,,"), words, F.lit("\r\n"))
        head = "[Script Info]\r\nTitle: x\r\n\r\n[Events]\r\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\r\n"
    else:
        line = F.concat(F.col("src_ix").cast("string"), F.lit("\n"), a, F.lit(" --> "), b, F.lit(" X1:10\n"), words, F.lit("\n\n"))
        head = ""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("src_ix", line.alias("l")))), lambda s: s["l"])
    return t.groupBy(F.col("track_id").alias("doc_id")).agg(F.concat(F.lit(head), F.array_join(rows, "")).alias("content"))


_NUM = "num AS (SELECT *, CAST(row_number() OVER (PARTITION BY track_id ORDER BY src_ix) - 1 AS INT) AS i FROM tracks)"


@query(f"WITH {TRACKS}, {_NUM} SELECT track_id AS doc_id, CAST(i AS INT) AS timed_ix, round(start_s, 3) AS start, round(stop_s, 3) AS stop, event_type = 'click' AS comment, CASE WHEN event_type = 'error' THEN '♪ ~' ELSE concat('{{\\i1}}line, ', CAST(src_ix AS VARCHAR)) END AS text FROM num")
def parse_styled(spark, sf_dir):
    x = SU.timed(SU.lines(documents(spark, sf_dir, "ass")))
    return x.select("doc_id", "timed_ix", F.round("start", 3).alias("start"), F.round("stop", 3).alias("stop"), "comment", "text")


@query(f"WITH {TRACKS}, {_NUM} SELECT track_id AS doc_id, CAST(i AS INT) AS timed_ix, round(start_s, 3) AS start, round(stop_s, 3) AS stop FROM num")
def parse_plain(spark, sf_dir):
    return SU.timed(SU.lines(documents(spark, sf_dir, "srt"))).select("doc_id", "timed_ix", F.round("start", 3).alias("start"), F.round("stop", 3).alias("stop"))


@query(f"WITH {TRACKS}, {_NUM} SELECT track_id AS doc_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY start_s, i) - 1 AS INT) AS cue_ix, i AS timed_ix FROM num WHERE event_type NOT IN ('click', 'error')")
def dialogue_projection(spark, sf_dir):
    return SU.dialogue(SU.timed(SU.lines(documents(spark, sf_dir, "ass")))).select("doc_id", "cue_ix", "timed_ix")


@query(f"WITH {TRACKS}, moved AS (SELECT *, sb + 250 AS a, sb + db + 250 AS b FROM tracks) SELECT track_id AS doc_id, string_agg(concat(CAST(src_ix AS VARCHAR), chr(10), {_hms('a', 'srt')}, ' --> ', {_hms('b', 'srt')}, ' X1:10', chr(10), CASE WHEN event_type = 'error' THEN '♪ ~' ELSE concat('{{\\i1}}line, ', CAST(src_ix AS VARCHAR)) END, chr(10), chr(10)), '' ORDER BY src_ix) AS content, count(*) AS rewritten, CAST(0 AS BIGINT) AS clamped FROM moved GROUP BY track_id")
def rewrite_shift(spark, sf_dir):
    d = documents(spark, sf_dir, "srt")
    of = SU.lines(d)
    t = SU.timed(of)
    return SU.rewrite(of, t, d.select("doc_id", F.lit(1.0).alias("scale"), F.lit(2.5).alias("shift")))


@query(f"WITH {TRACKS}, {_NUM} SELECT track_id AS doc_id, concat('[Script Info]', chr(13), chr(10), '; intervane: f | entry ', CAST(track_id AS VARCHAR), ' | +2.500s', chr(13), chr(10), 'Title: x') AS head FROM (SELECT DISTINCT track_id FROM num)")
def stamp_documents(spark, sf_dir):
    d = documents(spark, sf_dir, "ass").withColumn("kind", F.lit("ass"))
    note = F.concat(F.lit("f | entry "), F.col("doc_id").cast("string"), F.lit(" | "), T.describe(F.lit(1.0), F.lit(2.5)))
    once = SU.stamp(d, F.lit("older"))
    x = SU.stamp(once, note)
    return x.select("doc_id", F.concat(F.substring_index("content", "\r\n", 3)).alias("head"))


@query(f"WITH {TRACKS} SELECT track_id, src_ix, CASE WHEN db % 2 = 0 THEN concat('a', CAST(db AS VARCHAR), 'd') ELSE concat('b', CAST(db AS VARCHAR)) END AS plain, db % 2 = 1 AS karaoke FROM tracks")
def strip_and_karaoke(spark, sf_dir):
    n = F.col("db").cast("string")
    text = F.when(F.col("db") % 2 == 0, F.concat(F.lit("a{x{y}z}"), n, F.lit("d{\\i1}"))).otherwise(F.concat(F.lit("{\\k20}b"), n))
    x = tracks(spark, sf_dir).withColumn("text", text)
    return x.select("track_id", "src_ix", A.strip_blocks("text").alias("plain"), A.has_karaoke(F.col("text")).alias("karaoke"))


@query(f"WITH {FILES}, {MEASURED} SELECT file_id AS item_id, CASE WHEN verdict <> 'Declined' THEN 'info' ELSE 'warning' END AS severity, CASE WHEN verdict <> 'Declined' THEN concat('attached ', name) ELSE 'declined: weak' END AS message FROM measured")
def activity_log(spark, sf_dir):
    x = measured(spark, sf_dir).select(F.col("file_id").alias("item_id"), F.lit(None).cast("timestamp").alias("at"), "verdict", F.col("name").alias("file_name"), F.lit("weak").alias("reason"))
    return stores.log_rows(x).select("item_id", "severity", "message")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type = 'purchase' AS playing, event_type = 'view' AS recent, bool_or(event_type = 'purchase') OVER () AS any_playing FROM events) WHERE playing OR (NOT any_playing AND recent)")
def session_targets(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("playing"), (F.col("event_type") == "view").alias("recent"))
    return H.targets(e, F.lit(True)).select("user_id", "event_id")


@query("SELECT o_orderkey AS item_id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 250")
def library_scan(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").alias("added"), F.col("o_orderstatus").alias("status"))
    return stores.library(o, F.col("status") == "O").select("item_id")


@query("WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'Applied' ELSE 'Declined' END AS status, o_orderkey % 2 = 0 AS chosen, o_orderkey % 5 = 0 AS manual FROM orders) SELECT k, status = 'Applied' AND chosen AND NOT manual AS learns FROM x")
def learn_from(spark, sf_dir):
    k = F.col("o_orderkey")
    x = read(spark, sf_dir, "orders").select(k.alias("k"), F.when(k % 3 == 0, "Applied").otherwise("Declined").alias("status"), (k % 2 == 0).alias("chosen_by_user"), (k % 5 == 0).alias("manual"))
    return H.learns(x).select("k", "learns")
