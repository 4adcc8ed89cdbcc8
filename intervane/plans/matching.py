"""Queries on candidate files: filters, names, scores, ranks, preferences, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from intervane.config import Settings
from intervane.functions import messages as MS
from intervane.functions import names as N
from intervane.functions import script as S
from intervane.functions import timing as T
from intervane.operators import align as AL
from intervane.operators import bias as B
from intervane.operators import candidates as CA
from intervane.operators import consensus as CO
from intervane.operators import ranking as R
from intervane.plans.derived import FILES, MEASURED, files, measured, read
from intervane.plans.registry import query
from intervane.sources import remote, stores

EXT = "lower(regexp_extract(name, '\\.([^./]*)$', 1))"
MADE = "regexp_matches(name, '[\\[(]?(whisperai)[\\])]?|[\\[(]whisper[\\])]', 'i')"
TOKENS = "regexp_split_to_array(lower(name), '[.\\[\\]()_\\- ,&+{}@]+')"
_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_JA, _ZH = f"list_has_any({TOKENS}, {_list(N.JAPANESE)})", f"list_has_any({TOKENS}, {_list(N.CHINESE)})"
_BOTH = " OR ".join(f"contains(lower(name), '{w}')" for w in N.BILINGUAL)
LANGUAGE = f"CASE WHEN {_BOTH} OR ({_JA} AND {_ZH}) THEN 'Multilingual' WHEN {_JA} THEN 'JapaneseOnly' WHEN {_ZH} THEN 'NoJapanese' ELSE 'Unknown' END"
_PLAIN = f"bool_or({EXT} IN ('ass', 'ssa', 'srt') AND NOT {MADE} AND size >= 500) OVER (PARTITION BY episode_id)"
REJECTION = f"CASE WHEN {MADE} THEN 'machine' WHEN {LANGUAGE} = 'NoJapanese' THEN 'no japanese' WHEN {EXT} IN ('rar', '7z') THEN 'unreadable archive' WHEN {EXT} = 'zip' AND {_PLAIN} THEN 'archive not needed' WHEN {EXT} = 'zip' THEN 'none' WHEN {EXT} NOT IN ('ass', 'ssa', 'srt') THEN 'extension' WHEN size < 500 THEN 'too small' ELSE 'none' END"
EPISODE = ["episode_id"]
_VIDEO = "concat('[G', CAST(episode_id % 50 AS {t}), '] Show - 02 (BD 1920x1080 HEVC FLAC).mkv')"


@query(f"WITH {FILES} SELECT file_id, {REJECTION} AS rejection FROM files")
def candidate_filter(spark, sf_dir):
    return CA.rejection(files(spark, sf_dir), EPISODE).select("file_id", "rejection")


@query(f"WITH {FILES} SELECT file_id, {LANGUAGE} AS language FROM files")
def language_by_name(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", N.language(F.col("name")).alias("language"))


_SCORE = "CASE WHEN number <> 2 THEN 0 ELSE (CASE WHEN l_suppkey % 50 = episode_id % 50 THEN 45 ELSE 0 END) + (CASE WHEN l_quantity > 25 THEN 35 ELSE 0 END) + (CASE WHEN l_discount > 0.05 THEN 10 ELSE 0 END) + 10 END"


def _matched(of, to: str):
    """Files matched with the video of their episode, whose second episode is wanted."""
    x = CA.with_releases(of.withColumn("_video", F.expr(_VIDEO.format(t="STRING"))), {"_video": "_v", "name": "_s"})
    return x.withColumn(to, N.agree(F.col("_v"), F.col("_s"), F.lit(2))).drop("_video", "_v", "_s")


@query(f"WITH {FILES} SELECT file_id, {_SCORE} AS score, number <> 2 AS episode_mismatch, number = 2 AND l_quantity <= 25 AS source_mismatch, number = 2 AND l_quantity > 25 AS source_match FROM files")
def name_score(spark, sf_dir):
    return _matched(files(spark, sf_dir), "m").select("file_id", "m.score", "m.episode_mismatch", "m.source_mismatch", "m.source_match")


_RANKED = f"""cand AS (SELECT *, {REJECTION} AS rejection, {LANGUAGE} AS language, {_SCORE} AS score, l_suppkey % 3 = 0 AS preferred FROM files),
ranked AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY (rejection = 'none' AND number = 2) DESC, CASE language WHEN 'JapaneseOnly' THEN 0 WHEN 'Unknown' THEN 0 WHEN 'Multilingual' THEN 1 ELSE 2 END, preferred DESC, score DESC, lower(name), entry_id, file_id) AS place FROM cand)"""


def _candidates(spark, sf_dir):
    f = CA.rejection(_matched(files(spark, sf_dir), "_m"), EPISODE)
    return f.withColumn("score", F.col("_m.score")).withColumn("usable", (F.col("rejection") == "none") & ~F.col("_m.episode_mismatch")).withColumn("language", N.language(F.col("name"))).withColumn("preferred", F.col("l_suppkey") % 3 == 0).drop("_m")


@query(f"WITH {FILES}, {_RANKED} SELECT episode_id, file_id, CAST(place AS INT) AS place FROM ranked WHERE place <= 8")
def candidate_rank_topk(spark, sf_dir):
    return CA.rank(_candidates(spark, sf_dir), EPISODE).select("episode_id", "file_id", "place")


@query(f"WITH {FILES} SELECT file_id FROM files f WHERE NOT EXISTS (SELECT 1 FROM files r WHERE r.episode_id = f.episode_id AND lower(r.name) = lower(f.name) AND r.l_tax < 0.03)")
def anti_join_rejected(spark, sf_dir):
    f = files(spark, sf_dir)
    bad = f.where("l_tax < 0.03").withColumn("name", F.upper("name"))
    return CA.not_rejected_before(f, bad, EPISODE).select("file_id")


@query(f"WITH {FILES} SELECT entry_id, lower(name) AS low, min(file_id) AS file_id FROM files GROUP BY entry_id, lower(name)")
def seen_once(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("low", F.lower("name"))
    return CA.seen_once(f, ["entry_id", "low"], ["file_id"]).select("entry_id", "low", "file_id")


@query(f"WITH {FILES}, a AS (SELECT *, bool_or(number = 2) OVER (PARTITION BY episode_id) AS hit FROM files) SELECT episode_id, file_id, hit AS filtered_by_server FROM a WHERE NOT hit OR number = 2")
def filtered_or_all(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("matches", F.col("number") == 2)
    return CA.filtered_or_all(f, EPISODE, "matches").select("episode_id", "file_id", "filtered_by_server")


@query(f"WITH {FILES}, a AS (SELECT *, l_quantity > 25 AS anime FROM files) SELECT episode_id, file_id FROM (SELECT *, dense_rank() OVER (PARTITION BY episode_id ORDER BY CASE WHEN anime THEN 1 ELSE 2 END) AS k FROM a) WHERE k = 1")
def two_pass_search(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("anime", F.col("l_quantity") > 25)
    return remote.two_pass(f, EPISODE).select("episode_id", "file_id")


_EPISODES = "eps AS (SELECT o_orderkey AS k, o_custkey % 400 AS tvdb_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 3 + 1 AS INT) END AS season, CAST(o_orderkey % 30 + 1 AS INT) AS episode FROM orders)"
_MAPS = "maps AS (SELECT CAST(p_partkey % 400 AS BIGINT) AS tvdb_id, CASE WHEN p_partkey % 17 = 0 THEN -1 ELSE CAST(p_size % 3 + 1 AS INT) END AS tvdb_season, CAST(p_partkey // 400 * 12 AS INT) AS tvdb_offset, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_partkey AS INT) END AS anilist_id FROM part)"
_ASOF = """abso AS (SELECT tvdb_id, min(anilist_id) AS id FROM maps WHERE tvdb_season = -1 AND anilist_id IS NOT NULL GROUP BY tvdb_id),
found AS (SELECT k, episode, a.id AS anilist_id, episode AS entry_episode, 1 AS rank FROM eps JOIN abso a USING (tvdb_id)
UNION ALL SELECT k, episode, anilist_id, episode - tvdb_offset, row_number() OVER (PARTITION BY k ORDER BY tvdb_offset DESC, anilist_id) FROM eps JOIN maps USING (tvdb_id) WHERE tvdb_id NOT IN (SELECT tvdb_id FROM abso) AND anilist_id IS NOT NULL AND (season IS NULL OR tvdb_season = season) AND tvdb_offset < episode)"""


def _lookups(spark, sf_dir):
    o, p = read(spark, sf_dir, "orders"), read(spark, sf_dir, "part")
    e = o.select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 400).alias("tvdb_id"), F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") % 3 + 1).cast("int")).alias("season"), (F.col("o_orderkey") % 30 + 1).cast("int").alias("episode"))
    m = p.select((F.col("p_partkey") % 400).alias("tvdb_id"), F.when(F.col("p_partkey") % 17 == 0, -1).otherwise((F.col("p_size") % 3 + 1).cast("int")).alias("tvdb_season"), (F.expr("p_partkey div 400") * 12).cast("int").alias("tvdb_offset"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey").cast("int")).alias("anilist_id"))
    return e, CA.tvdb_lookups(e, m)


@query(f"WITH {_EPISODES}, {_MAPS}, {_ASOF} SELECT k, CAST(anilist_id AS INT) AS anilist_id, CAST(entry_episode AS INT) AS entry_episode, CAST(rank AS INT) AS rank FROM found")
def offset_mapping_asof(spark, sf_dir):
    return _lookups(spark, sf_dir)[1].select("k", "anilist_id", "entry_episode", "rank")


_CHAIN = """chain AS (SELECT k, anilist_id, entry_episode, 1 AS priority, rank FROM found UNION ALL SELECT k, CAST(tvdb_id + 5 AS INT), episode, 2, 1 FROM eps WHERE tvdb_id % 2 = 0 UNION ALL SELECT k, CAST(tvdb_id AS INT), episode, 3, 1 FROM eps WHERE tvdb_id % 5 = 0),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, anilist_id, entry_episode ORDER BY priority, rank) AS n FROM chain) WHERE n = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY priority, rank, anilist_id, entry_episode) AS place FROM once)"""


def _chain(spark, sf_dir):
    e, found = _lookups(spark, sf_dir)
    cols = ["k", "anilist_id", "entry_episode"]
    a = found.select(*cols, F.lit(1).alias("priority"), "rank")
    b = e.where("tvdb_id % 2 = 0").select("k", (F.col("tvdb_id") + 5).cast("int").alias("anilist_id"), F.col("episode").alias("entry_episode"), F.lit(2).alias("priority"), F.lit(1).alias("rank"))
    c = e.where("tvdb_id % 5 = 0").select("k", F.col("tvdb_id").cast("int").alias("anilist_id"), F.col("episode").alias("entry_episode"), F.lit(3).alias("priority"), F.lit(1).alias("rank"))
    return CA.fallback_chain(a.unionByName(b).unionByName(c), ["k"], ["anilist_id", "entry_episode"])


@query(f"WITH {_EPISODES}, {_MAPS}, {_ASOF}, {_CHAIN} SELECT k, CAST(anilist_id AS INT) AS anilist_id, CAST(entry_episode AS INT) AS entry_episode, CAST(place AS INT) AS place FROM placed WHERE place <= 4")
def lookup_fallback(spark, sf_dir):
    return _chain(spark, sf_dir).select("k", "anilist_id", "entry_episode", "place")


@query(f"WITH {_EPISODES}, {_MAPS}, {_ASOF}, {_CHAIN}, hits AS (SELECT k, anilist_id, place, l_linenumber AS number FROM placed JOIN lineitem ON l_partkey = anilist_id AND l_linenumber = entry_episode WHERE place <= 4) SELECT k, CAST(anilist_id AS INT) AS anilist_id, number FROM (SELECT *, dense_rank() OVER (PARTITION BY k ORDER BY place) AS d FROM hits) WHERE d = 1")
def first_productive_lookup(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("int").alias("anilist_id"), F.col("l_linenumber").alias("entry_episode"), F.col("l_linenumber").alias("number"))
    hits = _chain(spark, sf_dir).join(li, ["anilist_id", "entry_episode"])
    return CA.first_productive(hits, ["k"]).select("k", "anilist_id", "number")


_QUALITY = "round_even(coalesce(coverage, 0.0) * 100, 0) / 100 + round_even(correlation * 100, 0) / 100 / 10.0 + least(ratio, 5.0) / 1000.0 - least(abs(shift), 30.0) / 100000.0"


@query(f"WITH {FILES}, {MEASURED} SELECT file_id, round({_QUALITY}, 9) AS quality FROM measured")
def quality_score(spark, sf_dir):
    q = R.quality(F.col("coverage"), F.col("correlation"), F.col("ratio"), F.col("shift"))
    return measured(spark, sf_dir).select("file_id", F.round(q, 9).alias("quality"))


_LANG_RANK = "CASE language WHEN 'JapaneseOnly' THEN 0 WHEN 'Unknown' THEN 0 WHEN 'Multilingual' THEN 1 ELSE 2 END"


@query(f"""WITH {FILES}, {MEASURED}, q AS (SELECT *, {_QUALITY} AS quality, {_LANG_RANK} AS lr FROM measured WHERE verdict <> 'Declined'),
r AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY lr, quality DESC, score DESC, file_id) AS place FROM q),
g AS (SELECT episode_id, min(CASE WHEN source_match THEN place END) AS sp, min(CASE WHEN preferred THEN place END) AS pp FROM r GROUP BY episode_id),
m AS (SELECT t.episode_id, CASE WHEN NOT t.source_match AND s.place IS NOT NULL AND s.lr <= t.lr AND t.quality - s.quality <= 0.05 THEN s.place ELSE 1 END AS mid, pp FROM g JOIN r t ON t.episode_id = g.episode_id AND t.place = 1 LEFT JOIN r s ON s.episode_id = g.episode_id AND s.place = sp),
f AS (SELECT m.episode_id, m.mid, CASE WHEN p.place > 1 AND p.lr <= c.lr AND c.quality - p.quality <= 0.05 THEN p.place ELSE m.mid END AS fin, m.pp FROM m JOIN r c ON c.episode_id = m.episode_id AND c.place = m.mid LEFT JOIN r p ON p.episode_id = m.episode_id AND p.place = m.pp)
SELECT f.episode_id, r.file_id, CAST(f.fin AS INT) AS place, CASE WHEN f.fin = f.pp AND f.fin <> f.mid THEN 'series' WHEN f.mid <> 1 THEN 'source' ELSE 'rank' END AS chosen_by FROM f JOIN r ON r.episode_id = f.episode_id AND r.place = f.fin""")
def preference_override(spark, sf_dir):
    x = measured(spark, sf_dir).where("verdict <> 'Declined'")
    x = x.withColumn("quality", R.quality(F.col("coverage"), F.col("correlation"), F.col("ratio"), F.col("shift")))
    return R.choose(R.ranked(x, EPISODE), EPISODE)


@query(f"WITH {FILES}, {MEASURED} SELECT episode_id, file_id, correlation FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY correlation DESC, file_id) AS k FROM measured WHERE verdict = 'Declined') WHERE k = 1")
def closest_declined(spark, sf_dir):
    return R.closest_declined(measured(spark, sf_dir), EPISODE)


_BIAS = """votes AS (SELECT episode_id, shift FROM measured WHERE abs(scale - 1.0) < 1e-9 OR verdict = 'Declined'),
cons AS (SELECT v.episode_id, max(m.n) AS n, count(*) FILTER (WHERE abs(shift - med) <= 0.15) AS agreeing, avg(CASE WHEN abs(shift - med) <= 0.15 THEN shift END) AS mean FROM votes v JOIN (SELECT episode_id, median(shift) AS med, count(*) AS n FROM votes GROUP BY episode_id) m USING (episode_id) GROUP BY v.episode_id),
found AS (SELECT episode_id, mean AS bias FROM cons WHERE agreeing >= 3 AND CAST(agreeing AS DOUBLE) / n >= 0.75 AND abs(mean) >= 0.02),
x AS (SELECT m.*, CASE WHEN f.bias IS NOT NULL AND abs(scale - 1.0) < 1e-9 THEN f.bias END AS b FROM measured m LEFT JOIN found f USING (episode_id)),
y AS (SELECT *, shift - coalesce(b, 0.0) AS ns, b IS NOT NULL AND verdict IN ('Exact', 'ConstantOffset') AS judged FROM x)"""


@query(f"WITH {FILES}, {MEASURED}, {_BIAS} SELECT file_id, CASE WHEN judged AND abs(ns) < 0.137 THEN 'Exact' WHEN judged THEN 'ConstantOffset' ELSE verdict END AS verdict, round(CASE WHEN judged AND abs(ns) < 0.137 THEN 0.0 ELSE ns END, 9) AS shift, round(coalesce(b, 0.0), 9) AS bias FROM y")
def bias_apply(spark, sf_dir):
    x = B.correct(measured(spark, sf_dir), EPISODE, Settings(min_correction=0.137))
    return x.select("file_id", "verdict", F.round("shift", 9).alias("shift"), F.round("bias", 9).alias("bias"))


@query(f"WITH {FILES}, {MEASURED} SELECT file_id, abs(shift) <= 0.5 AND abs(scale - 1.0) <= 0.0005 AS sane FROM measured")
def sane_correction(spark, sf_dir):
    return measured(spark, sf_dir).select("file_id", T.sane(F.col("scale"), F.col("shift"), 0.5, 0.0005).alias("sane"))


@query(f"""WITH {FILES}, {MEASURED}, x AS (SELECT *, CASE WHEN file_id % 13 = 0 THEN CAST(file_id % 5 AS DOUBLE) / 2.0 END AS mo, file_id % 7 = 0 AS ex, file_id % 5 > 0 AS hr, file_id % 2 = 0 AS fo, file_id % 3 = 0 AS um FROM measured),
p AS (SELECT *, CASE WHEN mo IS NOT NULL THEN 'manual' WHEN ex THEN 'checksum' WHEN NOT hr AND fo THEN 'unverified' WHEN NOT hr THEN 'no reference' WHEN verdict <> 'Declined' OR NOT fo THEN 'aligned' WHEN um AND NOT (abs(scale - 1.0) < 1e-9 AND abs(shift) < 1e-9) THEN 'measured anyway' ELSE 'unchanged anyway' END AS path FROM x)
SELECT file_id, path, CASE WHEN path = 'manual' THEN (CASE WHEN abs(mo) < 1e-9 THEN 'Exact' ELSE 'ConstantOffset' END) WHEN path IN ('checksum', 'unverified', 'unchanged anyway') THEN 'Exact' WHEN path = 'no reference' THEN 'Declined' WHEN path = 'measured anyway' THEN (CASE WHEN abs(scale - 1.0) < 1e-9 THEN 'ConstantOffset' ELSE 'FramerateDrift' END) ELSE verdict END AS verdict FROM p""")
def evaluate_precedence(spark, sf_dir):
    k = F.col("file_id")
    x = measured(spark, sf_dir).withColumns({"manual_offset": F.when(k % 13 == 0, (k % 5) / 2.0), "exact_release": k % 7 == 0, "has_reference": k % 5 > 0, "force": k % 2 == 0, "use_measured": k % 3 == 0})
    return AL.precedence(x).select("file_id", "path", F.col("final_verdict").alias("verdict"))


@query(f"WITH {FILES} SELECT file_id, concat(regexp_replace(name, '\\.[^.]*$', ''), '.ja.', {EXT}) AS sidecar, starts_with(lower(name), '[g1') AND {EXT} IN ('ass', 'ssa', 'srt') AS looks FROM files")
def sidecar_names(spark, sf_dir):
    f = files(spark, sf_dir)
    side = N.sidecar_name(F.concat(F.lit("/v/"), F.col("name")), F.lit("JA"), F.concat(F.lit("."), N.extension(F.col("name"))))
    dotted = F.concat(F.lit("/v/"), F.regexp_replace("name", r"^\[G1", "[G1."), F.lit(""))
    looks = N.looks_like_ours(F.regexp_replace(dotted, r"\.([^.]*)$", ".ja.$1"), F.lit("[G1"), F.lit("JA"))
    return f.select("file_id", side.alias("sidecar"), looks.alias("looks"))


@query("WITH w AS (SELECT DISTINCT concat('ep', CAST(l_orderkey % 97 AS VARCHAR)) AS base, 'ja' AS tag, 'ass' AS ext FROM lineitem), e AS (SELECT DISTINCT CASE WHEN l_linenumber = 1 THEN concat('ep', CAST(l_orderkey % 97 AS VARCHAR), '.ja.ass') ELSE concat('ep', CAST(l_orderkey % 97 AS VARCHAR), '.', CAST(l_linenumber - 1 AS VARCHAR), '.ja.ass') END AS path FROM lineitem WHERE l_partkey < 100), t AS (SELECT base, n, CASE WHEN n = 0 THEN concat(base, '.ja.ass') ELSE concat(base, '.', CAST(n AS VARCHAR), '.ja.ass') END AS path FROM w CROSS JOIN range(0, 100) r(n)) SELECT base, arg_min(path, n) AS path FROM t WHERE path NOT IN (SELECT path FROM e) GROUP BY base")
def free_sidecar_names(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    base = F.concat(F.lit("ep"), (F.col("l_orderkey") % 97).cast("string"))
    wanted = li.select(base.alias("base"), F.lit("ja").alias("tag"), F.lit("ass").alias("ext")).distinct()
    have = li.where("l_partkey < 100").select(F.when(F.col("l_linenumber") == 1, F.concat(base, F.lit(".ja.ass"))).otherwise(F.concat(base, F.lit("."), (F.col("l_linenumber") - 1).cast("string"), F.lit(".ja.ass"))).alias("path"))
    return stores.free_names(wanted, have).select("base", "path")


@query("SELECT o_orderkey AS k, rtrim(replace(replace(to_base64(CAST(concat('{\"e\":', CAST(o_orderkey AS VARCHAR), ',\"n\":\"', o_orderpriority, '?~\"}') AS BLOB)), '+', '-'), '/', '_'), '=') AS id, TRUE AS same FROM orders")
def opaque_ids(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("n", F.concat("o_orderpriority", F.lit("?~")))
    x = o.select(F.col("o_orderkey").alias("k"), "n", N.opaque_id(F.struct(F.col("o_orderkey").alias("e"), "n")).alias("id"))
    back = N.from_opaque_id(F.col("id"), "e bigint, n string")
    return x.select("k", "id", ((back["e"] == F.col("k")) & (back["n"] == F.col("n"))).alias("same"))


@query("SELECT k, TRY_CAST(trim(split_part(t, ',', 1)) AS INT) AS n FROM (SELECT p_partkey AS k, CASE p_size % 5 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN concat(CAST(p_partkey AS VARCHAR), ',', CAST(p_size AS VARCHAR)) WHEN 2 THEN '' WHEN 3 THEN p_name ELSE NULL END AS t FROM part)")
def lenient_int(spark, sf_dir):
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    t = F.when(F.col("p_size") % 5 == 0, k).when(F.col("p_size") % 5 == 1, F.concat(k, F.lit(","), F.col("p_size").cast("string"))).when(F.col("p_size") % 5 == 2, "").when(F.col("p_size") % 5 == 3, F.col("p_name"))
    return p.select(F.col("p_partkey").alias("k"), N.lenient_int(t).alias("n"))


@query("SELECT p_partkey AS k, CASE p_size % 4 WHEN 0 THEN concat(CAST(p_partkey AS VARCHAR), 'p') WHEN 1 THEN '720p' WHEN 2 THEN NULL ELSE 'hd' END AS resolution, CASE p_size % 4 WHEN 0 THEN 'BD' WHEN 1 THEN 'WEB' WHEN 2 THEN NULL ELSE 'LASER' END AS family FROM part")
def normalised_names(spark, sf_dir):
    p, m = read(spark, sf_dir, "part"), F.col("p_size") % 4
    res = F.when(m == 0, F.concat(F.lit("1920X"), F.col("p_partkey").cast("string"))).when(m == 1, " 720P ").when(m == 2, " ").otherwise("HD")
    src = F.when(m == 0, "Blu-Ray").when(m == 1, "web-dl").when(m == 2, "").otherwise("laser")
    return p.select(F.col("p_partkey").alias("k"), N.resolution(res).alias("resolution"), N.source_family(src).alias("family"))


@query("WITH s AS (SELECT l_orderkey AS k, l_linenumber AS stream, CASE WHEN l_returnflag = 'N' THEN 'ass' ELSE 'pgs' END AS codec, CASE WHEN l_linestatus = 'O' THEN 'Signs & Songs' ELSE 'Full' END AS title, l_tax > 0.06 AS forced, l_discount < 0.03 AS is_default FROM lineitem) SELECT k, stream, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN codec = 'ass' THEN 0 ELSE 1 END, CASE WHEN forced OR title <> 'Full' THEN 1 ELSE 0 END, CASE WHEN is_default THEN 0 ELSE 1 END, stream) AS place FROM s) WHERE place <= 6")
def stream_order(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    s = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("stream"), F.when(F.col("l_returnflag") == "N", "ass").otherwise("pgs").alias("codec"), F.when(F.col("l_linestatus") == "O", "Signs & Songs").otherwise("Full").alias("title"), (F.col("l_tax") > 0.06).alias("forced"), (F.col("l_discount") < 0.03).alias("is_default"))
    return CO.stream_order(s, "k").select("k", "stream", "place")


@query("SELECT l_orderkey AS k, arg_min(l_linenumber, {'a': CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_discount < 0.03 THEN 1 ELSE 2 END, 'b': l_linenumber}) AS stream FROM lineitem GROUP BY l_orderkey")
def audio_stream(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    s = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("stream"), F.when(F.col("l_returnflag") == "R", "JPN").otherwise("eng").alias("language"), (F.col("l_discount") < 0.03).alias("is_default"))
    return CO.audio_stream(s, "k")


_SCRIPT = "SELECT doc_id, length(regexp_replace(text, '[^\\p{Hiragana}\\p{Katakana}]', '', 'g')) AS kana, length(regexp_replace(text, '[^\\p{Han}]', '', 'g')) AS han, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters FROM documents"


@query(f"SELECT doc_id, CAST(kana AS BIGINT) AS kana, CAST(han AS BIGINT) AS han, CAST(letters - kana - han AS BIGINT) AS other FROM ({_SCRIPT})")
def script_profile(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", S.counts(F.col("text")).alias("c")).select("doc_id", "c.*")


@query(f"SELECT doc_id, CASE WHEN letters < 200 THEN 'Unknown' WHEN CAST(kana AS DOUBLE) / letters < 0.10 THEN 'NoJapanese' WHEN CAST(kana AS DOUBLE) / letters < 0.55 AND CAST(han AS DOUBLE) / letters > 0.30 THEN 'Multilingual' ELSE 'JapaneseOnly' END AS language FROM ({_SCRIPT})")
def language_by_content(spark, sf_dir):
    c = read(spark, sf_dir, "documents").select("doc_id", S.counts(F.col("text")).alias("c")).select("doc_id", "c.*")
    n = F.col("kana") + F.col("han") + F.col("other")
    return c.select("doc_id", S.classify(F.try_divide("kana", n), F.try_divide("han", n), n).alias("language"))


@query("SELECT c_custkey AS k, CASE WHEN season = 0 THEN concat(c_name, CASE WHEN c_nationkey % 2 = 0 THEN concat(' ', c_mktsegment) ELSE '' END) WHEN season > 1 THEN concat(c_name, ' ', CAST(season AS VARCHAR)) ELSE c_name END AS query, concat(CAST(c_nationkey AS VARCHAR), '|', CAST(season AS VARCHAR), '|') AS fingerprint FROM (SELECT *, c_custkey % 4 AS season FROM customer)")
def name_queries(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("season", F.col("c_custkey") % 4)
    title = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment"))
    return c.select(F.col("c_custkey").alias("k"), N.name_query(F.col("c_name"), F.col("season"), title).alias("query"), N.fingerprint(F.col("c_nationkey"), F.col("season"), F.lit(None)).alias("fingerprint"))


@query("SELECT CAST(p_partkey AS INT) AS anidb_id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS INT) END AS tvdb_id, CASE WHEN p_size % 2 = 0 THEN CAST(p_partkey % 50 AS INT) END AS anilist_id, CAST(0 AS INT) AS tvdb_offset FROM part")
def id_mapping_json(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    tvdb = F.when(F.col("p_size") % 3 == 0, F.lit('"x"')).otherwise(F.col("p_size").cast("string"))
    ani = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('"'), (F.col("p_partkey") % 50).cast("string"), F.lit(',7"'))).otherwise(F.lit("null"))
    text = p.select(F.concat(F.lit('{"'), k, F.lit('":{"tvdb_id":'), tvdb, F.lit(',"anilist_id":'), ani, F.lit("}}")).alias("value"))
    return stores.id_mappings(text).select("anidb_id", "tvdb_id", "anilist_id", "tvdb_offset")


@query("SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS INT) END AS whole, CASE WHEN p_size % 3 = 0 THEN concat(CAST(p_size AS VARCHAR), '.5') END AS text FROM part")
def fractional_episode(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    n = F.col("p_size").cast("string")
    name = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Show S01E"), n, F.lit(".5 [1080p].ass"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("Show 5.1 FLAC "), n)).otherwise(F.concat(F.lit("Show - "), n, F.lit(" 10.2 Mbps")))
    return p.select(F.col("p_partkey").alias("k"), N.fractional_episode(name).alias("f")).select("k", F.col("f.whole").alias("whole"), F.col("f.text").alias("text"))


@query("""WITH x AS (SELECT p_partkey AS k, CAST(p_partkey % 100 AS DOUBLE) / 100.0 AS c, CAST(p_partkey % 37 AS DOUBLE) / 20.0 AS r, p_size % 5 AS v FROM part)
SELECT k, CASE WHEN c < 0.5 AND r < 1.2 THEN concat('no convincing alignment: correlation ', printf('%.2f', c), ' of 0.50, uniqueness ', printf('%.2f', r), ' of 1.20') WHEN c < 0.5 THEN concat('correlation ', printf('%.2f', c), ' is below 0.50') WHEN r < 1.2 THEN concat('uniqueness ', printf('%.2f', r), ' is below 1.20') END AS weak,
CASE v WHEN 0 THEN 'already in sync' WHEN 1 THEN 'shifted by +1.500s' WHEN 2 THEN 'rescaled: +1.500s' WHEN 3 THEN 'matched in sections' ELSE 'declined: unknown' END AS outcome,
CASE WHEN k % 4 = 0 THEN 'reference: stream 2' WHEN k % 4 = 1 THEN 'no embedded subtitle streams' WHEN k % 4 = 2 THEN concat(CAST(k % 4 AS VARCHAR), ' streams, none usable') ELSE 'no reference chosen' END AS note FROM x""")
def explanations(spark, sf_dir):
    k = F.col("p_partkey")
    c, r = (k % 100).cast("double") / 100.0, (k % 37).cast("double") / 20.0
    verdict = F.element_at(F.array(*map(F.lit, ("Exact", "ConstantOffset", "FramerateDrift", "PiecewiseCut", "Declined"))), (F.col("p_size") % 5 + 1).cast("int"))
    note = MS.reference_note(F.when(k % 4 == 1, 0).otherwise((k % 4).cast("int")), F.when(k % 4 == 3, 1).otherwise(0), F.when(k % 4 == 0, "stream 2"))
    return read(spark, sf_dir, "part").select(k.alias("k"), MS.weak_match(c, r, F.lit(0.5), F.lit(1.2)).alias("weak"), MS.outcome(verdict, T.describe(F.lit(1.0), F.lit(1.5)), F.lit(None).cast("string")).alias("outcome"), note.alias("note"))
