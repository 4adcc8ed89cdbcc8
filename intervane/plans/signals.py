"""Queries on tracks: bins, correlation, coverage, gates, blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from intervane import config as C
from intervane.functions import timing as T
from intervane.operators import align as AL
from intervane.operators import bias as B
from intervane.operators import consensus as CO
from intervane.operators import correlate as X
from intervane.operators import coverage as CV
from intervane.operators import intervals as I
from intervane.operators import packets as P
from intervane.operators import piecewise as PW
from intervane.plans.derived import PROBES, SHIFT, TRACKS, probes, read, tracks
from intervane.plans.registry import query

KEY = ["track_id"]
LIMIT, GUARD = 6000, 100


def bins_sql(source: str, kind: str = "presence", scale: str = "CAST(1.0 AS DOUBLE)", extra: str = "") -> str:
    s = f"CAST(round_even(start_s * {scale} * 100, 0) AS BIGINT)"
    e = f"greatest(CAST(round_even(least(stop_s * {scale}, start_s * {scale} + 10.0) * 100, 0) AS BIGINT), {s} + 1)" if kind == "presence" else f"{s} + 20"
    return f"SELECT track_id{extra}, src_ix, {s} AS s, {e} AS e FROM {source} WHERE stop_s > start_s"


def merge_sql(bins: str, keys: str = "track_id") -> str:
    return f"SELECT {keys}, min(s) AS s, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY s, e, src_ix ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY {keys} ORDER BY s, e, src_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ({bins}))) GROUP BY {keys}, g"


def length_sql(source: str, scale: str = "CAST(1.0 AS DOUBLE)", keys: str = "track_id") -> str:
    return f"SELECT {keys}, CAST(ceil(arg_max(stop_s * {scale}, {{'a': start_s, 'b': src_ix}}) * 100) + 2 AS BIGINT) AS n_bins FROM {source} WHERE stop_s > start_s GROUP BY {keys}"


def clip_sql(merged: str, lengths: str, keys: str = "track_id") -> str:
    return f"SELECT {keys}, greatest(s, 0) AS s, least(e, n_bins) AS e FROM ({merged}) JOIN ({lengths}) USING ({keys}) WHERE least(e, n_bins) > greatest(s, 0)"


def correlate_sql(keys: str = "track_id", limit: int = LIMIT, guard: int = GUARD) -> str:
    """WITH clauses from ra, pb (merged) and na, nb (lengths) to fits: every pair of edges, no pruning."""
    k = [c.strip() for c in keys.split(",")]
    on = " AND ".join(f"a.{c} = b.{c}" for c in k)
    own = ", ".join(f"a.{c}" for c in k)
    return f"""ea AS (SELECT {keys}, s AS x, 1 AS w FROM ra UNION ALL SELECT {keys}, e, -1 FROM ra), eb AS (SELECT {keys}, s AS x, 1 AS w FROM pb UNION ALL SELECT {keys}, e, -1 FROM pb),
raw AS (SELECT {own}, a.x - b.x AS lag, -sum(a.w * b.w) AS imp FROM ea a JOIN eb b ON {on} GROUP BY ALL),
padded AS (SELECT {keys}, lag, CAST(sum(imp) AS BIGINT) AS imp FROM (SELECT {keys}, lag, imp FROM raw WHERE lag <= {limit} UNION ALL SELECT DISTINCT {keys}, -{limit}, 0 FROM raw UNION ALL SELECT DISTINCT {keys}, {limit}, 0 FROM raw) GROUP BY ALL),
sloped AS (SELECT *, sum(imp) OVER w AS slope, lag(lag) OVER w AS before, lead(lag) OVER w AS until FROM padded WINDOW w AS (PARTITION BY {keys} ORDER BY lag)),
risen AS (SELECT *, coalesce(lag(slope) OVER w * (lag - before), 0) AS rise FROM sloped WINDOW w AS (PARTITION BY {keys} ORDER BY lag)),
points AS (SELECT * FROM (SELECT {keys}, lag, until, slope, CAST(sum(rise) OVER (PARTITION BY {keys} ORDER BY lag ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ov FROM risen) WHERE lag BETWEEN -{limit} AND {limit}),
best AS (SELECT {keys}, arg_max(lag, {{'v': ov, 'n': -lag}}) AS blag, max(ov) AS bov FROM points GROUP BY {keys}),
second AS (SELECT {keys}, greatest(coalesce(max(CASE WHEN abs(lag - blag) > {guard} THEN ov END), 0), coalesce(max(CASE WHEN blag - {guard} - 1 >= -{limit} AND lag <= blag - {guard} - 1 AND coalesce(until > blag - {guard} - 1, TRUE) THEN ov + slope * (blag - {guard} - 1 - lag) END), 0), coalesce(max(CASE WHEN blag + {guard} + 1 <= {limit} AND lag <= blag + {guard} + 1 AND coalesce(until > blag + {guard} + 1, TRUE) THEN ov + slope * (blag + {guard} + 1 - lag) END), 0)) AS sec FROM points JOIN best USING ({keys}) GROUP BY {keys}),
sizes AS (SELECT {keys}, CAST(ea AS DOUBLE) AS ea, CAST(eb AS DOUBLE) AS eb, CAST(greatest(x.n_bins, y.n_bins) AS DOUBLE) AS n FROM (SELECT {keys}, sum(e - s) AS ea FROM ra GROUP BY {keys}) JOIN (SELECT {keys}, sum(e - s) AS eb FROM pb GROUP BY {keys}) USING ({keys}) JOIN na x USING ({keys}) JOIN nb y USING ({keys})),
fits AS (SELECT {keys}, CASE WHEN coalesce(bov, 0) > 0 THEN blag ELSE 0 END AS lag, greatest(coalesce(bov, 0), 0) AS overlap, CASE WHEN coalesce(bov, 0) > 0 THEN CAST(sec AS BIGINT) ELSE 0 END AS second,
 CASE WHEN coalesce(bov, 0) > 0 AND ea < n AND eb < n THEN (bov - ea * eb / n) / sqrt(ea * (1 - ea / n) * eb * (1 - eb / n)) ELSE 0.0 END AS correlation,
 CASE WHEN coalesce(bov, 0) <= 0 THEN 0.0 WHEN sec > 0 THEN CAST(bov AS DOUBLE) / sec ELSE 999.0 END AS peak_ratio
 FROM sizes LEFT JOIN best USING ({keys}) LEFT JOIN second USING ({keys}))"""


_PAIR = f"""WITH {TRACKS}, {PROBES}, na AS ({length_sql('tracks')}), nb AS ({length_sql('probes')}),
ra AS ({clip_sql(merge_sql(bins_sql('tracks')), 'SELECT * FROM na')}), pb AS ({clip_sql(merge_sql(bins_sql('probes')), 'SELECT * FROM nb')}), {correlate_sql()}"""


def signals(spark, sf_dir, onset: bool = False):
    """(reference, probe, bins of the reference, bins of the probe): merged and cut to their lengths."""
    make = I.onset_bins if onset else I.presence_bins
    a = tracks(spark, sf_dir)
    b = probes(a)
    out = []
    for d in (a, b):
        n = I.lengths(d, KEY)
        out.append((I.clip(I.merge(make(d.where("stop > start")), KEY).join(n, KEY), F.col("n_bins")).drop("n_bins"), n))
    return out[0][0], out[1][0], out[0][1], out[1][1]


@query(f"WITH {TRACKS} SELECT track_id, src_ix, CAST(row_number() OVER (PARTITION BY track_id ORDER BY s, src_ix) - 1 AS INT) AS cue_ix, s, e FROM ({bins_sql('tracks')})")
def track_bins(spark, sf_dir):
    x = I.presence_bins(I.ordered(tracks(spark, sf_dir), KEY))
    return x.select("track_id", "src_ix", "cue_ix", "s", "e")


@query(f"WITH {TRACKS} SELECT track_id, src_ix, s, e FROM ({bins_sql('tracks', 'onset')})")
def onset_bins(spark, sf_dir):
    return I.onset_bins(tracks(spark, sf_dir).where("stop > start")).select("track_id", "src_ix", "s", "e")


@query(f"WITH {TRACKS} SELECT track_id, s, e FROM ({merge_sql(bins_sql('tracks'))})")
def track_merge(spark, sf_dir):
    return I.merge(I.presence_bins(tracks(spark, sf_dir).where("stop > start")), KEY)


@query(f"WITH {TRACKS} SELECT track_id, CAST(sum(e - s) AS BIGINT) AS energy, count(*) AS n_intervals FROM ({clip_sql(merge_sql(bins_sql('tracks')), length_sql('tracks'))}) GROUP BY track_id")
def track_energy(spark, sf_dir):
    t = tracks(spark, sf_dir)
    return I.energy(I.clip(I.merge(I.presence_bins(t.where("stop > start")), KEY).join(I.lengths(t, KEY), KEY), F.col("n_bins")), KEY)


@query(f"{_PAIR} SELECT track_id, CAST(max(ov) AS BIGINT) AS most, CAST(min(ov) AS BIGINT) AS least FROM points GROUP BY track_id")
def xcorr_overlap(spark, sf_dir):
    return X.overlaps(*signals(spark, sf_dir), KEY, LIMIT, GUARD).select("track_id", F.col("overlap").alias("most"), "least")


@query(f"{_PAIR} SELECT track_id, CAST(lag AS BIGINT) AS lag, CAST(overlap AS BIGINT) AS overlap, second, CAST(lag AS BIGINT) = -(({SHIFT})) AS recovered FROM fits")
def xcorr_best_lag(spark, sf_dir):
    x = X.correlate(*signals(spark, sf_dir), KEY)
    return x.select("track_id", F.col("lag").cast("long").alias("lag"), "overlap", "second", (F.col("lag") == -F.expr(SHIFT)).alias("recovered"))


@query(f"{_PAIR} SELECT track_id, CAST(lag AS BIGINT) AS lag, CAST(overlap AS BIGINT) AS overlap, round(correlation, 9) AS correlation, round(peak_ratio, 9) AS peak_ratio, CASE WHEN NOT (correlation >= 0.5 AND peak_ratio >= 1.2) THEN 'Declined' WHEN abs(lag / 100.0) > 30.0 THEN 'Declined' WHEN abs(lag / 100.0) < 0.15 THEN 'Exact' ELSE 'ConstantOffset' END AS verdict FROM fits")
def xcorr_score(spark, sf_dir):
    x = X.correlate(*signals(spark, sf_dir), KEY)
    x = AL.decide(x.withColumn("scale", F.lit(1.0)).withColumn("shift", F.col("lag") / 100.0).withColumn("min_correlation", F.lit(0.5)).withColumn("karaoke", F.lit(False)))
    return x.select("track_id", F.col("lag").cast("long").alias("lag"), "overlap", F.round("correlation", 9).alias("correlation"), F.round("peak_ratio", 9).alias("peak_ratio"), "verdict")


_GRID = ", ".join(f"({k}, CAST({v!r} AS DOUBLE))" for k, v in enumerate(C.SCALES))
_SCALED = "scaled AS (SELECT probes.*, scale_ix, scale FROM probes CROSS JOIN grid)"


def _grid_sql(kind: str) -> str:
    keys = "track_id, scale_ix"
    return f"""WITH {TRACKS}, {PROBES}, grid(scale_ix, scale) AS (VALUES {_GRID}), {_SCALED},
n0 AS ({length_sql('tracks')}), na AS (SELECT track_id, scale_ix, n_bins FROM n0 CROSS JOIN grid), nb AS ({length_sql('scaled', 'scale', keys)}),
r0 AS ({clip_sql(merge_sql(bins_sql('tracks', kind)), 'SELECT * FROM n0')}), ra AS (SELECT track_id, scale_ix, s, e FROM r0 CROSS JOIN grid),
pb AS ({clip_sql(merge_sql(bins_sql('scaled', kind, 'scale', ', scale_ix'), keys), 'SELECT * FROM nb', keys)}), {correlate_sql(keys)},
ranked AS (SELECT f.*, scale FROM fits f JOIN grid USING (scale_ix)),
top AS (SELECT track_id, arg_max(scale_ix, {{'c': correlation, 'n': -scale_ix}}) AS tix, max(correlation) AS tcorr, max(CASE WHEN scale_ix = 0 THEN correlation END) AS pcorr FROM ranked GROUP BY track_id),
chosen AS (SELECT r.* FROM ranked r JOIN top t ON r.track_id = t.track_id AND r.scale_ix = CASE WHEN pcorr IS NOT NULL AND tcorr - pcorr < 0.02 THEN 0 ELSE tix END)"""


_FIT = "SELECT track_id, CAST(scale_ix AS INT) AS scale_ix, CAST(lag AS BIGINT) AS lag, CAST(overlap AS BIGINT) AS overlap, round(correlation, 9) AS correlation, round(peak_ratio, 9) AS peak_ratio FROM chosen"


def _fit(x):
    return x.select("track_id", "scale_ix", F.col("lag").cast("long").alias("lag"), "overlap", F.round("correlation", 9).alias("correlation"), F.round("peak_ratio", 9).alias("peak_ratio"))


@query(f"{_grid_sql('presence')} {_FIT}")
def scale_grid_fit(spark, sf_dir):
    a = tracks(spark, sf_dir)
    return _fit(X.best_fit(X.scale_grid(a, probes(a), KEY), KEY))


@query(f"{_grid_sql('onset')} {_FIT}")
def scale_grid_onsets(spark, sf_dir):
    a = tracks(spark, sf_dir)
    return _fit(X.best_fit(X.scale_grid(a, probes(a), KEY, onsets=True), KEY))


_ONSET_PAIR = f"""WITH {TRACKS}, {PROBES}, na AS ({length_sql('tracks')}), nb AS ({length_sql('probes')}),
ra AS ({clip_sql(merge_sql(bins_sql('tracks', 'onset')), 'SELECT * FROM na')}), pb AS ({clip_sql(merge_sql(bins_sql('probes', 'onset')), 'SELECT * FROM nb')}), {correlate_sql()}"""
_HYP = f"""WITH o AS (SELECT * FROM ({_PAIR} SELECT * FROM fits)), s AS (SELECT * FROM ({_ONSET_PAIR} SELECT * FROM fits)),
h AS (SELECT 0 AS rep_ix, 'overlap' AS representation, CAST(0.5 AS DOUBLE) AS lo, track_id, lag, correlation, peak_ratio FROM o UNION ALL SELECT 1, 'onsets', CAST(0.25 AS DOUBLE), track_id, lag, correlation, peak_ratio FROM s),
m AS (SELECT *, correlation >= lo AND peak_ratio >= 1.2 AS passes, least(correlation / lo, peak_ratio / 1.2) AS margin FROM h)
SELECT track_id, representation, CAST(lag AS BIGINT) AS lag, passes, round(margin, 9) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY passes DESC, margin DESC, rep_ix) AS k FROM m) WHERE k = 1"""


@query(_HYP)
def hypothesis_choice(spark, sf_dir):
    parts = []
    for k, (name, least) in enumerate((("overlap", 0.5), ("onsets", 0.25))):
        x = X.correlate(*signals(spark, sf_dir, name == "onsets"), KEY)
        parts.append(x.select("track_id", F.lit(k).alias("rep_ix"), F.lit(name).alias("representation"), F.lit(least).alias("min_correlation"), F.col("lag").cast("long").alias("lag"), "correlation", "peak_ratio"))
    h = X.choose_hypothesis(parts[0].unionByName(parts[1]), KEY)
    return h.select("track_id", "representation", "lag", "passes", F.round("margin", 9).alias("margin"))


_COVER = f"""WITH {TRACKS}, {PROBES}, fixed AS (SELECT track_id, src_ix, start_s - CAST({SHIFT} AS DOUBLE) / 100.0 + (src_ix % 5) * 0.2 AS t, stop_s - start_s AS d FROM probes),
a AS (SELECT track_id, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM fixed f WHERE f.track_id = tracks.track_id AND abs(f.t - tracks.start_s) <= 0.5)) AS c FROM tracks GROUP BY track_id),
b AS (SELECT track_id, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM tracks t WHERE t.track_id = fixed.track_id AND abs(fixed.t - t.start_s) <= 0.5)) AS c, least(sum(d) / 1440.0, 1.0) AS shown FROM fixed GROUP BY track_id)
SELECT track_id, round(CAST(a.c AS DOUBLE) / a.n, 9) AS reference_covered, round(CAST(b.c AS DOUBLE) / b.n, 9) AS probe_matched, round(shown, 9) AS on_screen FROM a JOIN b USING (track_id)"""


@query(_COVER)
def coverage_semi_join(spark, sf_dir):
    a = tracks(spark, sf_dir)
    moved = F.col("start") - F.expr(SHIFT).cast("double") / 100.0 + (F.col("src_ix") % 5) * F.lit(0.2)
    p = probes(a).withColumn("_d", F.col("stop") - F.col("start")).withColumn("start", moved).withColumn("stop", F.col("start") + F.col("_d"))
    total = a.select("track_id").distinct().withColumn("total", F.lit(1440.0))
    x = CV.measure(a, p, KEY, total)
    return x.select("track_id", *[F.round(c, 9).alias(c) for c in ("reference_covered", "probe_matched", "on_screen")])


_RUN = "SELECT *, greatest(start_s, coalesce(max(stop_s) OVER (PARTITION BY track_id ORDER BY start_s, src_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_s)) AS f FROM tracks"
_SPAN = "arg_max(stop_s, {'a': start_s, 'b': src_ix}) - min(start_s)"


@query(f"WITH {TRACKS} SELECT track_id, round(CASE WHEN {_SPAN} > 60 THEN least(sum(greatest(stop_s - f, 0.0)) / ({_SPAN}), 1.0) ELSE 0.0 END, 9) AS duty FROM ({_RUN}) GROUP BY track_id")
def duty_union(spark, sf_dir):
    return I.duty_union(tracks(spark, sf_dir), KEY).select("track_id", F.round("duty", 9).alias("duty"))


@query(f"WITH {TRACKS} SELECT track_id, round(least(sum(stop_s - start_s) / ({_SPAN}), 1.0), 9) AS duty FROM tracks GROUP BY track_id")
def duty_sum(spark, sf_dir):
    return I.duty_sum(tracks(spark, sf_dir), KEY).select("track_id", F.round("duty", 9).alias("duty"))


@query(f"WITH {TRACKS} SELECT track_id, CAST(list_sort(list(db))[CAST(floor(count(*) / 2.0) AS BIGINT) + 1] AS BIGINT) AS median_upper FROM tracks GROUP BY track_id")
def median_upper(spark, sf_dir):
    return I.median_upper(tracks(spark, sf_dir), KEY, "db")


@query(f"WITH {TRACKS} SELECT track_id, round(CASE WHEN {_SPAN} > 60 THEN count(*) / (({_SPAN}) / 60.0) ELSE 0.0 END, 9) AS per_minute FROM tracks GROUP BY track_id")
def cues_per_minute(spark, sf_dir):
    return I.cues_per_minute(tracks(spark, sf_dir), KEY).select("track_id", F.round("per_minute", 9).alias("per_minute"))


_COARSE = "coarse AS (SELECT track_id, src_ix, CAST(sb // 500 * 500 AS DOUBLE) / 100.0 AS start_s, CAST(sb // 500 * 500 + 200 AS DOUBLE) / 100.0 AS stop_s FROM tracks)"


def _coarse(spark, sf_dir):
    """Cues on a grid of five seconds, so that some fall together."""
    at = F.floor(F.col("sb") / 500) * 500
    return tracks(spark, sf_dir).select("track_id", "src_ix", (at / 100.0).alias("start"), ((at + 200) / 100.0).alias("stop"))


@query(f"WITH {TRACKS}, {_COARSE} SELECT track_id, min(src_ix) AS src_ix, start_s AS start, stop_s AS stop FROM coarse GROUP BY track_id, start_s, stop_s")
def dedup_cues(spark, sf_dir):
    return I.dedup(_coarse(spark, sf_dir), KEY)


@query(f"""WITH {TRACKS}, once AS (SELECT track_id, min(src_ix) AS src_ix, start_s, stop_s FROM tracks GROUP BY track_id, CAST(round_even(start_s * 100, 0) AS BIGINT), CAST(round_even(stop_s * 100, 0) AS BIGINT), start_s, stop_s),
c AS (SELECT track_id, count(*) AS n_cues FROM tracks GROUP BY track_id),
d AS (SELECT track_id, CASE WHEN {_SPAN} > 60 THEN least(sum(greatest(stop_s - f, 0.0)) / ({_SPAN}), 1.0) ELSE 0.0 END AS duty, CASE WHEN {_SPAN} > 60 THEN count(*) / (({_SPAN}) / 60.0) ELSE 0.0 END AS per_minute FROM ({_RUN.replace('FROM tracks', 'FROM once')}) GROUP BY track_id)
SELECT track_id, n_cues, round(duty, 9) AS duty, round(per_minute, 9) AS per_minute, CASE WHEN n_cues < 10 THEN 'few' WHEN duty > 0.85 THEN 'always on' WHEN per_minute > 90 THEN 'dense' ELSE 'ok' END AS gate FROM c JOIN d USING (track_id)""")
def quality_gates(spark, sf_dir):
    x = I.quality_gates(tracks(spark, sf_dir), KEY)
    return x.select("track_id", "n_cues", F.round("duty", 9).alias("duty"), F.round("per_minute", 9).alias("per_minute"), "gate")


@query(f"WITH {TRACKS}, r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_s, src_ix) AS a, count(*) OVER (PARTITION BY track_id) AS n FROM tracks) SELECT track_id, src_ix, CASE WHEN a <= 4 THEN 'first' ELSE 'last' END AS part FROM r WHERE a <= 4 OR a > greatest(4, n - 4)")
def sample_ends(spark, sf_dir):
    return I.sample_ends(tracks(spark, sf_dir), KEY).select("track_id", "src_ix", "part")


@query(f"WITH {TRACKS}, r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_s, src_ix) AS a, count(*) OVER (PARTITION BY track_id) AS n FROM tracks) SELECT track_id, CAST(max(floor(n * 0.35::DOUBLE)) AS BIGINT) AS n_segment, round(avg(CASE WHEN a <= floor(n * 0.35::DOUBLE) THEN start_s END), 6) AS front, round(avg(CASE WHEN a > n - floor(n * 0.35::DOUBLE) THEN start_s END), 6) AS back FROM r GROUP BY track_id")
def end_segments(spark, sf_dir):
    x = I.end_segments(tracks(spark, sf_dir), KEY)
    return x.select("track_id", "n_segment", F.round("front", 6).alias("front"), F.round("back", 6).alias("back"))


@query(f"WITH {TRACKS} SELECT track_id, sb AS bin, CAST(w AS BIGINT) AS w, CAST(sum(w) OVER (PARTITION BY track_id ORDER BY sb ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM (SELECT track_id, sb, sum(db) AS w FROM tracks GROUP BY track_id, sb)")
def prefix_sums(spark, sf_dir):
    x = tracks(spark, sf_dir).groupBy("track_id", F.col("sb").alias("bin")).agg(F.sum("db").alias("w"))
    return I.prefix_sums(x, KEY)


_OFFSETS = "offs AS (SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY sb, src_ix) - 1 AS INT) AS cue_ix, CAST(sb // 36000 % 3 AS DOUBLE) AS off FROM tracks)"
_ISLANDS = "islands AS (SELECT track_id, CAST(g - 1 AS BIGINT) AS block_ix, min(cue_ix) AS first_cue, max(cue_ix) AS last_cue, min(off) AS off FROM (SELECT *, sum(t) OVER (PARTITION BY track_id ORDER BY cue_ix ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN lag(off) OVER (PARTITION BY track_id ORDER BY cue_ix) = off THEN 0 ELSE 1 END AS t FROM offs)) GROUP BY track_id, g)"


def _offsets(spark, sf_dir):
    x = I.ordered(tracks(spark, sf_dir), KEY)
    return x.select("track_id", "cue_ix", (F.floor(F.col("sb") / 36000) % 3).cast("double").alias("offset"))


@query(f'WITH {TRACKS}, {_OFFSETS}, {_ISLANDS} SELECT track_id, block_ix, first_cue, last_cue, off AS "offset" FROM islands')
def blocks_islands(spark, sf_dir):
    return PW.islands(_offsets(spark, sf_dir), KEY).withColumn("block_ix", F.col("block_ix").cast("long"))


@query(f"WITH {TRACKS}, {PROBES}, {_OFFSETS}, {_ISLANDS}, p AS (SELECT track_id, src_ix, CAST(row_number() OVER (PARTITION BY track_id ORDER BY sb, src_ix) - 1 AS INT) AS cue_ix FROM probes) SELECT p.track_id, p.src_ix, p.cue_ix, off AS \"offset\" FROM p JOIN (SELECT *, lead(first_cue) OVER (PARTITION BY track_id ORDER BY block_ix) AS following FROM islands) i ON i.track_id = p.track_id AND p.cue_ix >= first_cue AND (following IS NULL OR p.cue_ix < following)")
def block_offsets(spark, sf_dir):
    p = I.ordered(probes(tracks(spark, sf_dir)), KEY).select("track_id", "src_ix", "cue_ix")
    return PW.block_offsets(p, PW.islands(_offsets(spark, sf_dir), KEY), KEY).select("track_id", "src_ix", "cue_ix", "offset")


@query(f"WITH {TRACKS} SELECT track_id, src_ix, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN CAST(db AS DOUBLE) END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY src_ix ROWS UNBOUNDED PRECEDING), -1.0) AS \"offset\" FROM tracks")
def carry_forward(spark, sf_dir):
    x = tracks(spark, sf_dir).select("track_id", "src_ix", F.col("src_ix").alias("line_ix"), F.when(F.col("event_type") == "purchase", F.col("db").cast("double")).alias("offset"), F.lit(-1.0).alias("seed"))
    return PW.carry_forward(x, KEY).select("track_id", "src_ix", "offset")


_VOTES = "votes AS (SELECT track_id, src_ix, CAST(sb % 50 AS DOUBLE) / 200.0 + CASE WHEN event_type = 'error' THEN 3.0 ELSE 0.0 END AS shift FROM tracks)"
_CONSENSUS = "SELECT track_id, n, CASE WHEN n >= 3 THEN agreeing ELSE 0 END AS agreeing, CASE WHEN agreeing >= 3 AND CAST(agreeing AS DOUBLE) / n >= 0.75 THEN mean END AS bias FROM (SELECT v.track_id, max(m.n) AS n, count(*) FILTER (WHERE abs(shift - med) <= 0.15) AS agreeing, avg(CASE WHEN abs(shift - med) <= 0.15 THEN shift END) AS mean FROM votes v JOIN (SELECT track_id, median(shift) AS med, count(shift) AS n FROM votes GROUP BY track_id) m ON m.track_id = v.track_id GROUP BY v.track_id)"


@query(f"WITH {TRACKS}, {_VOTES} SELECT track_id, n, agreeing, round(bias, 9) AS bias FROM ({_CONSENSUS})")
def bias_consensus(spark, sf_dir):
    x = tracks(spark, sf_dir).select("track_id", ((F.col("sb") % 50) / 200.0 + F.when(F.col("event_type") == "error", 3.0).otherwise(0.0)).alias("shift"))
    return B.consensus(x, KEY).withColumn("bias", F.round("bias", 9))


_PACKETS = "packets AS (SELECT track_id, src_ix, CAST(sb AS DOUBLE) / 100.0 AS pts, CASE WHEN event_type IN ('view', 'click') THEN CAST(db AS DOUBLE) / 100.0 ELSE 0.0 END AS duration, CASE WHEN event_type = 'error' THEN 20 ELSE 900 END AS size FROM tracks)"


def _packets(spark, sf_dir):
    return tracks(spark, sf_dir).select("track_id", "src_ix", (F.col("sb") / 100.0).alias("pts"), F.when(F.col("event_type").isin("view", "click"), F.col("db") / 100.0).otherwise(0.0).alias("duration"), F.when(F.col("event_type") == "error", 20).otherwise(900).alias("size"))


@query(f"""WITH {TRACKS}, {_PACKETS}, numbered AS (SELECT *, sum(CASE WHEN size < 48 THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY src_ix ROWS UNBOUNDED PRECEDING) AS c FROM packets),
shown AS (SELECT * FROM numbered WHERE size >= 48),
erased AS (SELECT s.track_id, s.c, arg_min(e.pts, {{'a': e.pts <= s.pts, 'b': e.src_ix}}) AS pts FROM shown s JOIN numbered e ON e.track_id = s.track_id AND e.c = s.c AND e.size < 48 GROUP BY s.track_id, s.c),
closed AS (SELECT s.*, CASE WHEN s.duration > 0 THEN s.duration WHEN e.pts IS NOT NULL THEN greatest(e.pts - s.pts, 0.0) ELSE s.duration END AS d FROM shown s LEFT JOIN erased e ON e.track_id = s.track_id AND e.c = s.c),
judged AS (SELECT *, avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY track_id) >= 0.5 AS trusted, coalesce(lead(pts) OVER (PARTITION BY track_id ORDER BY src_ix) - pts, 2.0) AS gap FROM closed),
done AS (SELECT *, CASE WHEN d > 0 THEN d ELSE least(gap, CASE WHEN trusted THEN 10.0 ELSE 2.0 END) END AS dur FROM judged)
SELECT track_id, src_ix, round(pts, 6) AS start, round(pts + dur, 6) AS stop FROM done WHERE dur >= 0.05""")
def packet_durations(spark, sf_dir):
    x = P.cues(_packets(spark, sf_dir), KEY)
    return x.select("track_id", "src_ix", F.round("start", 6).alias("start"), F.round("stop", 6).alias("stop"))


@query(f"""WITH {TRACKS}, lines AS (SELECT track_id, src_ix, concat(CAST(src_ix % 3 AS VARCHAR), ',', CAST(sb AS VARCHAR), ',', CASE WHEN event_type = 'error' THEN 'N/A' ELSE CAST(db AS VARCHAR) END, ',', CAST(db * 3 AS VARCHAR)) AS line FROM tracks)
SELECT track_id, stream, count(*) AS n, sum(pts) AS pts, sum(duration) AS duration, CAST(sum(size) AS BIGINT) AS size FROM (SELECT track_id, CAST(split_part(line, ',', 1) AS INT) AS stream, CAST(split_part(line, ',', 2) AS DOUBLE) AS pts, coalesce(TRY_CAST(split_part(line, ',', 3) AS DOUBLE), 0.0) AS duration, CAST(split_part(line, ',', 4) AS INT) AS size FROM lines) GROUP BY track_id, stream""")
def packet_streams(spark, sf_dir):
    t = tracks(spark, sf_dir)
    line = F.concat_ws(",", (F.col("src_ix") % 3).cast("string"), F.col("sb").cast("string"), F.when(F.col("event_type") == "error", "N/A").otherwise(F.col("db").cast("string")), (F.col("db") * 3).cast("string"))
    x = P.parse(t.select("track_id", "src_ix", line.alias("line")), KEY)
    return x.groupBy("track_id", "stream").agg(F.count("*").alias("n"), F.sum("pts").alias("pts"), F.sum("duration").alias("duration"), F.sum("size").alias("size"))


@query(f"WITH {TRACKS}, lib AS (SELECT DISTINCT track_id, CAST(src_ix % 4 AS INT) AS stream FROM tracks), lib2 AS (SELECT *, CAST(row_number() OVER (PARTITION BY track_id ORDER BY stream) AS INT) AS ordinal FROM lib), probed AS (SELECT track_id, CAST(src_ix % 4 + 2 AS INT) AS stream, count(*) AS n_packets FROM tracks GROUP BY ALL), probed2 AS (SELECT *, CAST(row_number() OVER (PARTITION BY track_id ORDER BY stream) AS INT) AS ordinal FROM probed) SELECT l.track_id, l.stream, l.ordinal, coalesce(a.n_packets, b.n_packets) AS n_packets FROM lib2 l LEFT JOIN probed2 a ON a.track_id = l.track_id AND a.stream = l.stream LEFT JOIN probed2 b ON b.track_id = l.track_id AND b.ordinal = l.ordinal")
def stream_match(spark, sf_dir):
    from pyspark.sql import Window

    t = tracks(spark, sf_dir)
    w = Window.partitionBy("track_id").orderBy("stream")
    lib = t.select("track_id", (F.col("src_ix") % 4).cast("int").alias("stream")).distinct().withColumn("ordinal", F.row_number().over(w))
    probed = t.groupBy("track_id", (F.col("src_ix") % 4 + 2).cast("int").alias("stream")).agg(F.count("*").alias("n_packets")).withColumn("ordinal", F.row_number().over(w))
    return P.match_streams(lib, probed, "track_id").select("track_id", "stream", "ordinal", "n_packets")


_THREE = """three AS (SELECT track_id, 1 AS tr, src_ix, start_s, stop_s FROM tracks WHERE event_type <> 'error' UNION ALL SELECT track_id, 2, src_ix, start_s, stop_s FROM tracks WHERE event_type <> 'view' UNION ALL SELECT track_id, 3, src_ix, start_s + 1.0, stop_s + 1.0 FROM tracks),
counted AS (SELECT track_id, tr FROM three GROUP BY ALL HAVING count(*) >= 10),
cues AS (SELECT track_id, tr, min(src_ix) AS src_ix, arg_min(start_s, src_ix) AS start_s, arg_min(stop_s, src_ix) AS stop_s FROM three JOIN counted USING (track_id, tr) GROUP BY track_id, tr, CAST(round_even(start_s * 100, 0) AS BIGINT), CAST(round_even(stop_s * 100, 0) AS BIGINT))"""
_LAST = "SELECT track_id, tr, count(*) AS n_cues, arg_max(stop_s, {'a': start_s, 'b': src_ix}) AS last FROM cues GROUP BY track_id, tr"


@query(f"""WITH {TRACKS}, {_THREE}, ends AS ({_LAST}), pairs AS (SELECT a.track_id, a.tr AS i, b.tr AS j FROM ends a JOIN ends b ON a.track_id = b.track_id AND a.tr < b.tr),
n0 AS (SELECT track_id, CAST(ceil(max(last) * 100) + 2 AS BIGINT) AS n_bins FROM ends GROUP BY track_id), n1 AS (SELECT track_id, tr, CAST(ceil(last * 100) + 2 AS BIGINT) AS n_bins FROM ends),
mm AS ({merge_sql(bins_sql('cues', 'onset', extra=', tr'), 'track_id, tr')}),
na AS (SELECT track_id, i, j, n_bins FROM pairs JOIN n0 USING (track_id)), nb AS (SELECT p.track_id, i, j, n_bins FROM pairs p JOIN n1 ON n1.track_id = p.track_id AND n1.tr = p.j),
ra AS (SELECT p.track_id, i, j, greatest(s, 0) AS s, least(e, n_bins) AS e FROM pairs p JOIN mm ON mm.track_id = p.track_id AND mm.tr = p.i JOIN n0 ON n0.track_id = p.track_id WHERE least(e, n_bins) > greatest(s, 0)),
pb AS (SELECT p.track_id, i, j, greatest(s, 0) AS s, least(e, n_bins) AS e FROM pairs p JOIN mm ON mm.track_id = p.track_id AND mm.tr = p.j JOIN n1 ON n1.track_id = p.track_id AND n1.tr = p.j WHERE least(e, n_bins) > greatest(s, 0)),
{correlate_sql('track_id, i, j', 3000)},
agree AS (SELECT track_id, i, j FROM fits WHERE abs(lag) <= 15), votes AS (SELECT track_id, tr, count(*) AS agreed FROM (SELECT track_id, i AS tr FROM agree UNION ALL SELECT track_id, j FROM agree) GROUP BY ALL)
SELECT e.track_id AS episode_id, e.tr AS track, n_cues, coalesce(agreed, 0) AS agreed, row_number() OVER (PARTITION BY e.track_id ORDER BY coalesce(agreed, 0) DESC, n_cues DESC, e.tr) = 1 AS chosen FROM ends e LEFT JOIN votes v ON v.track_id = e.track_id AND v.tr = e.tr""")
def consensus_tracks(spark, sf_dir):
    """Each user's cues as three tracks of one episode, the third late by a second."""
    t = tracks(spark, sf_dir)
    parts = [t.where("event_type <> 'error'").withColumn("track", F.lit(1)), t.where("event_type <> 'view'").withColumn("track", F.lit(2)), t.withColumn("track", F.lit(3)).withColumn("start", F.col("start") + 1.0).withColumn("stop", F.col("stop") + 1.0)]
    x = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return CO.reference(x.select(F.col("track_id").alias("episode_id"), "track", "src_ix", "start", "stop"), "episode_id", "track")


@query(f"WITH {TRACKS}, f AS (SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY sb, src_ix) - 1 AS BIGINT) AS frame_no, CAST(db AS DOUBLE) / 400.0 AS score FROM tracks), b AS (SELECT track_id, unnest(range(0, CAST(ceil(count(*) * 0.032::DOUBLE * 100) AS BIGINT) + 2)) AS bin FROM f GROUP BY track_id) SELECT b.track_id, count(*) AS active, CAST(sum(bin) AS BIGINT) AS total FROM b JOIN f ON f.track_id = b.track_id AND f.frame_no = CAST(floor(b.bin * 0.01::DOUBLE / 0.032::DOUBLE) AS BIGINT) WHERE score >= 0.5 GROUP BY b.track_id")
def probability_bins(spark, sf_dir):
    f = I.ordered(tracks(spark, sf_dir), KEY).select("track_id", F.col("cue_ix").cast("long").alias("frame_no"), (F.col("db") / 400.0).alias("score"))
    return I.from_probabilities(f, KEY, 0.032).groupBy("track_id").agg(F.count("*").alias("active"), F.sum("bin").alias("total"))


_T = "SELECT o_orderkey AS k, CAST(o_totalprice AS DOUBLE) / 100.0 AS t FROM orders"


@query(f"""SELECT k, concat(CAST(cs // 360000 AS VARCHAR), ':', lpad(CAST(cs // 6000 % 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(cs // 100 % 60 AS VARCHAR), 2, '0'), '.', lpad(CAST(cs % 100 AS VARCHAR), 2, '0')) AS styled,
concat(lpad(CAST(ms // 3600000 AS VARCHAR), 2, '0'), ':', lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0'), ',', lpad(CAST(ms % 1000 AS VARCHAR), 3, '0')) AS plain
FROM (SELECT k, CAST(floor(t * 100.0 + 0.5) AS BIGINT) AS cs, CAST(floor(t * 1000.0 + 0.5) AS BIGINT) AS ms FROM ({_T}))""")
def timecode_format(spark, sf_dir):
    t = F.col("o_totalprice").cast("double") / 100.0
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), T.format_time(t, "ass").alias("styled"), T.format_time(t, "srt").alias("plain"))


@query(f"SELECT k, CAST(cs // 360000 * 3600 AS DOUBLE) + CAST(cs // 6000 % 60 * 60 AS DOUBLE) + CAST(concat(CAST(cs // 100 % 60 AS VARCHAR), '.', lpad(CAST(cs % 100 AS VARCHAR), 2, '0')) AS DOUBLE) AS seconds FROM (SELECT k, CAST(floor(t * 100.0 + 0.5) AS BIGINT) AS cs FROM ({_T}))")
def timecode_parse(spark, sf_dir):
    t = F.col("o_totalprice").cast("double") / 100.0
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), T.parse_time(T.format_time(t, "ass")).alias("seconds"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7001 = 0 THEN 'unchanged' ELSE concat(CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '+' END, CAST(o_orderkey % 7001 // 1000 AS VARCHAR), '.', lpad(CAST(o_orderkey % 7001 % 1000 AS VARCHAR), 3, '0'), 's') END AS described FROM orders")
def describe_transform(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    shift = F.when(F.col("o_orderkey") % 5 == 0, 0.0).otherwise((F.col("o_orderkey") % 7001) / 1000.0 * F.when(F.col("o_orderkey") % 2 == 0, -1.0).otherwise(1.0))
    return o.select(F.col("o_orderkey").alias("k"), T.describe(F.lit(1.0), shift).alias("described"))


@query(f"WITH {TRACKS}, f AS (SELECT track_id, min(start_s) AS a, arg_max(start_s, {{'x': start_s, 'y': src_ix}}) AS b FROM tracks GROUP BY track_id), g AS (SELECT track_id, a, b, CAST(track_id % 9 AS DOUBLE) / 4.0 AS p, CASE WHEN track_id % 3 > 0 THEN CAST(track_id % 11 AS DOUBLE) / 2.0 END AS q FROM f), h AS (SELECT *, q IS NOT NULL AND b - a > 1 AND abs(q - p) > 1e-9 AS st FROM g) SELECT track_id, round(CASE WHEN st THEN 1.0 + (q - p) / (b - a) ELSE 1.0 END, 9) AS scale, round(CASE WHEN st THEN p - (q - p) / (b - a) * a ELSE p END, 6) AS shift FROM h")
def manual_stretch(spark, sf_dir):
    f = tracks(spark, sf_dir).groupBy("track_id").agg(F.min("start").alias("a"), F.max("start").alias("b"))
    m = T.two_point((F.col("track_id") % 9) / 4.0, F.when(F.col("track_id") % 3 > 0, (F.col("track_id") % 11) / 2.0), F.col("a"), F.col("b"))
    return f.withColumn("m", m).select("track_id", F.round("m.scale", 9).alias("scale"), F.round("m.offset", 6).alias("shift"))
