"""Queries of alignment: piecewise program, drift refinement, verdicts, voice activity. The SQL says each in plain steps, without pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from intervane import config as C
from intervane.operators import align as AL
from intervane.operators import floor as FL
from intervane.operators import intervals as I
from intervane.operators import piecewise as PW
from intervane.operators import vad as V
from intervane.plans.derived import PROBES, TRACKS, probes, read, tracks
from intervane.plans.registry import query
from intervane.plans.signals import KEY, bins_sql, clip_sql, correlate_sql, length_sql, merge_sql

_WIDE = 2 * round(C.SPLIT_RADIUS * C.BINS) + 1
_PRICE = round(4 * C.SPLIT_PENALTY * C.BINS)


def piecewise_sql(cues: str, centre: str = "0") -> str:
    """WITH clauses (of WITH RECURSIVE) from ra, na and cues (track_id, src_ix, start_s, stop_s) to split_blocks and split_fits.

    Ratings are dense, four times over, so that they are whole numbers; the program goes cue by cue. centre: bins, of cues' rows.
    """
    half = _WIDE // 2
    return f"""sorted_cues AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_s, src_ix) - 1 AS cue_ix, CAST(round_even(start_s * 100, 0) AS BIGINT) AS a,
 greatest(CAST(round_even(start_s * 100, 0) AS BIGINT) + 1, CAST(round_even(stop_s * 100, 0) AS BIGINT)) AS b, {centre} - {half} AS first FROM {cues} WHERE stop_s > start_s),
placed AS (SELECT *, least(b - a, {C.SPLIT_GUARD}) AS g FROM sorted_cues SEMI JOIN ra USING (track_id)),
kinks AS (SELECT track_id, cue_ix, greatest(pos, 0) AS pos, CAST(sum(w) AS INT) AS w, CAST(sum(w * greatest(-pos, 0)) AS INT) AS carry FROM (
 SELECT p.track_id, p.cue_ix, (CASE edge WHEN 1 THEN r.s ELSE r.e END) - (CASE pt WHEN 1 THEN b WHEN 2 THEN a WHEN 3 THEN a - g ELSE b + g END) - first AS pos,
  (CASE edge WHEN 1 THEN 1 ELSE -1 END) * (CASE pt WHEN 1 THEN 5 WHEN 2 THEN -5 WHEN 3 THEN 1 ELSE -1 END) AS w
 FROM placed p JOIN ra r ON r.track_id = p.track_id AND r.e > a - g + first AND r.s < b + g + first + {_WIDE} CROSS JOIN (SELECT unnest([1, 2]) AS edge) CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS pt)
 UNION ALL SELECT track_id, cue_ix, 0, 0 FROM placed) WHERE pos < {_WIDE} GROUP BY ALL),
sloped_kinks AS (SELECT *, sum(w) OVER v AS slope, lag(pos) OVER v AS before, lead(pos, 1, {_WIDE}) OVER v AS until FROM kinks WINDOW v AS (PARTITION BY track_id, cue_ix ORDER BY pos)),
risen_kinks AS (SELECT *, carry + coalesce(lag(slope) OVER v * (pos - before), 0) AS rise FROM sloped_kinks WINDOW v AS (PARTITION BY track_id, cue_ix ORDER BY pos)),
rates AS MATERIALIZED (SELECT track_id, cue_ix, flatten(list(list_transform(range(0, until - pos), lambda k: CAST(v + slope * k AS INT)) ORDER BY pos)) AS r FROM (
 SELECT *, CAST(sum(rise) OVER (PARTITION BY track_id, cue_ix ORDER BY pos) AS INT) AS v FROM risen_kinks) GROUP BY track_id, cue_ix),
program(track_id, i, score, since, ks, bs) USING KEY (track_id) AS (
 SELECT track_id, 0::INT, r, list_transform(r, lambda x: 0::INT), [list_position(r, list_max(r))::BIGINT], [0::INT] FROM rates WHERE cue_ix = 0
 UNION SELECT track_id, i, score, since, list_append(ks, k), list_append(bs, since[k]) FROM (SELECT *, list_position(score, list_max(score))::BIGINT AS k FROM (
  SELECT p.track_id, CAST(p.i + 1 AS INT) AS i, list_transform(list_zip(q.r, p.score), lambda x: x[1] + greatest(x[2], p.leap)) AS score,
  list_transform(list_zip(p.score, p.since), lambda x: CASE WHEN p.leap > x[1] THEN CAST(p.i + 1 AS INT) ELSE x[2] END) AS since, ks, bs
  FROM (SELECT *, list_max(score) - {_PRICE} AS leap FROM program) p JOIN rates q ON q.track_id = p.track_id AND q.cue_ix = p.i + 1))),
chain AS (SELECT track_id, i AS last_cue, bs[len(bs)] AS first_cue, ks[len(ks)] AS k, ks, bs FROM program
 UNION ALL SELECT track_id, first_cue - 1, bs[first_cue], ks[first_cue], ks, bs FROM chain WHERE first_cue > 0),
split_blocks AS (SELECT c.track_id, CAST(row_number() OVER (PARTITION BY c.track_id ORDER BY c.first_cue) - 1 AS INT) AS block_ix, CAST(c.first_cue AS INT) AS first_cue, CAST(c.last_cue AS INT) AS last_cue,
 CAST(p.first + c.k - 1 AS DOUBLE) / 100.0 AS off FROM chain c JOIN placed p ON p.track_id = c.track_id AND p.cue_ix = c.first_cue),
shifted AS (SELECT p.track_id, p.src_ix, p.start_s + off AS start_s, p.stop_s + off AS stop_s FROM placed p JOIN split_blocks s ON s.track_id = p.track_id AND p.cue_ix BETWEEN s.first_cue AND s.last_cue),
again AS (SELECT track_id, n_bins AS n, CAST(ceil(CAST(n_bins - 2 AS DOUBLE) / 100.0 * 100.0) AS BIGINT) + 2 AS n_bins FROM na),
sc AS ({clip_sql(merge_sql(bins_sql('shifted')), 'SELECT track_id, n_bins FROM again')}),
split_fits AS (SELECT track_id, CASE WHEN ea < n AND eb < n THEN (coalesce(ov, 0) - ea * eb / n) / sqrt(ea * (1 - ea / n) * eb * (1 - eb / n)) ELSE 0.0 END AS split_correlation FROM
 (SELECT track_id, CAST(sum(e - s) AS DOUBLE) AS ea FROM ra GROUP BY track_id) JOIN (SELECT track_id, CAST(sum(e - s) AS DOUBLE) AS eb FROM sc GROUP BY track_id) USING (track_id)
 JOIN (SELECT track_id, CAST(n AS DOUBLE) AS n FROM again) USING (track_id)
 LEFT JOIN (SELECT r.track_id, sum(least(r.e, c.e) - greatest(r.s, c.s)) AS ov FROM ra r JOIN sc c ON c.track_id = r.track_id AND c.s < r.e AND c.e > r.s GROUP BY r.track_id) USING (track_id))"""


_CUT = "CASE WHEN start_s < 700 THEN -2.0::DOUBLE ELSE -9.0::DOUBLE END"


@query(f"""WITH RECURSIVE {TRACKS}, cut_probes AS (SELECT track_id, src_ix, start_s + {_CUT} AS start_s, stop_s + {_CUT} AS stop_s FROM tracks),
na AS ({length_sql('tracks')}), ra AS ({clip_sql(merge_sql(bins_sql('tracks')), 'SELECT * FROM na')}), {piecewise_sql('cut_probes')}
SELECT track_id, block_ix, first_cue, last_cue, off AS "offset", round(split_correlation, 9) AS correlation FROM split_blocks JOIN split_fits USING (track_id)""")
def piecewise_dp(spark, sf_dir):
    """Every track against itself with a cut: early by 2 s before 700 s, and by 9 s after it."""
    a = tracks(spark, sf_dir).select("track_id", "src_ix", "start", "stop")
    moved = F.when(F.col("start") < 700, -2.0).otherwise(-9.0)
    probe = a.select("track_id", "src_ix", (F.col("start") + moved).alias("start"), (F.col("stop") + moved).alias("stop"))
    x = PW.split(a, probe, KEY).select("track_id", F.round("correlation", 9).alias("correlation"), F.posexplode("blocks").alias("block_ix", "b"))
    return x.select("track_id", "block_ix", "b.first_cue", "b.last_cue", "b.offset", "correlation")


def fits_sql(ref: str, probe: str, keys: str = "track_id", spread: str = "") -> str:
    """A whole query: fits of probe (start_s, stop_s, onset) against the merged reference (ref, with {ref}_n), by keys. spread: FROM clause that gives the reference the other keys."""
    cut = f"SELECT {keys}, src_ix, CAST(round_even(start_s * 100, 0) AS BIGINT) AS s, CASE WHEN onset THEN CAST(round_even(start_s * 100, 0) AS BIGINT) + 20 ELSE greatest(CAST(round_even(least(stop_s, start_s + 10.0) * 100, 0) AS BIGINT), CAST(round_even(start_s * 100, 0) AS BIGINT) + 1) END AS e FROM {probe} WHERE stop_s > start_s"
    return f"""WITH na AS (SELECT {keys}, n_bins FROM {ref}_n{spread}), nb AS ({length_sql(probe, keys=keys)}), ra AS (SELECT {keys}, s, e FROM {ref}{spread}),
pb AS ({clip_sql(merge_sql(cut, keys), 'SELECT * FROM nb', keys)}), {correlate_sql(keys)} SELECT * FROM fits"""


def refine_sql(ref: str, cues: str, coarse: str) -> str:
    """WITH clauses from coarse (track_id, onset, scale, shift, correlation, peak_ratio) to refined: four passes, all pairs that improved so far in each."""
    out = [f"""counted AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_s, src_ix) - 1 AS cue_ix, count(*) OVER (PARTITION BY track_id) AS n FROM {cues} WHERE stop_s > start_s),
state0 AS MATERIALIZED (SELECT *, FALSE AS refined, TRUE AS live FROM {coarse})"""]
    for k in range(C.DRIFT_PASSES):
        out.append(f"""now{k} AS MATERIALIZED (SELECT c.track_id, c.src_ix, c.cue_ix, c.n, s.onset, scale * start_s + shift AS start_s, scale * stop_s + shift AS stop_s FROM counted c JOIN state{k} s USING (track_id) WHERE live AND floor(c.n * 0.35::DOUBLE) >= 8),
parts{k} AS MATERIALIZED (SELECT *, 0 AS part FROM now{k} WHERE cue_ix < floor(n * 0.35::DOUBLE) UNION ALL SELECT *, 1 FROM now{k} WHERE cue_ix >= n - floor(n * 0.35::DOUBLE)),
lags{k} AS MATERIALIZED ({fits_sql(ref, f'parts{k}', 'track_id, part', ' CROSS JOIN (SELECT unnest([0, 1]) AS part)')}),
ends{k} AS (SELECT track_id, max(CASE WHEN part = 0 THEN lag / 100.0::DOUBLE END) AS r0, max(CASE WHEN part = 1 THEN lag / 100.0::DOUBLE END) AS r1, max(CASE WHEN part = 0 THEN t END) AS t0, max(CASE WHEN part = 1 THEN t END) AS t1
 FROM lags{k} JOIN (SELECT track_id, part, avg(start_s) AS t FROM parts{k} GROUP BY ALL) USING (track_id, part) GROUP BY track_id),
tried{k} AS MATERIALIZED (SELECT track_id, onset, scale * extra AS new_scale, shift * extra + r0 - (extra - 1) * t0 AS new_shift, correlation FROM (SELECT *, 1 + (r1 - r0) / (t1 - t0) AS extra FROM state{k} JOIN ends{k} USING (track_id)
 WHERE live AND t1 - t0 >= 60 AND abs(r1 - r0) >= 0.25 AND abs((r1 - r0) / (t1 - t0)) <= 0.05)),
again{k} AS MATERIALIZED (SELECT c.track_id, c.src_ix, t.onset, new_scale * start_s + new_shift AS start_s, new_scale * stop_s + new_shift AS stop_s FROM counted c JOIN tried{k} t USING (track_id)),
check{k} AS MATERIALIZED ({fits_sql(ref, f'again{k}')}),
state{k + 1} AS MATERIALIZED (SELECT s.track_id, s.onset, CASE WHEN better THEN new_scale ELSE scale END AS scale, CASE WHEN better THEN new_shift ELSE shift END AS shift, CASE WHEN better THEN c ELSE correlation END AS correlation,
 CASE WHEN better THEN p ELSE peak_ratio END AS peak_ratio, refined OR better AS refined, better AS live FROM (SELECT s.*, new_scale, new_shift, c.correlation AS c, c.peak_ratio AS p, s.live AND coalesce(c.correlation > s.correlation, FALSE) AS better
 FROM state{k} s LEFT JOIN tried{k} t ON t.track_id = s.track_id LEFT JOIN check{k} c ON c.track_id = t.track_id) s)""")
    out.append(f"refined AS (SELECT * FROM state{C.DRIFT_PASSES})")
    return ",\n".join(out)


_LATE = "late AS (SELECT track_id, src_ix, (start_s - 1.85::DOUBLE) / 1.0034::DOUBLE AS start_s, (stop_s - 1.85::DOUBLE) / 1.0034::DOUBLE AS stop_s, FALSE AS onset FROM tracks)"


@query(f"""WITH {TRACKS}, {_LATE}, ref_n AS ({length_sql('tracks')}), ref AS MATERIALIZED ({clip_sql(merge_sql(bins_sql('tracks')), 'SELECT * FROM ref_n')}),
coarse AS (SELECT track_id, FALSE AS onset, 1.0::DOUBLE AS scale, lag / 100.0::DOUBLE AS shift, correlation, peak_ratio FROM ({fits_sql('ref', 'late')})), {refine_sql('ref', 'late', 'coarse')}
SELECT track_id, round(scale, 6) AS scale, round(shift, 4) AS shift, round(correlation, 6) AS correlation, refined FROM refined""")
def drift_refine(spark, sf_dir):
    """Every track against itself, slow by 0.34 % and late."""
    a = tracks(spark, sf_dir).select("track_id", "src_ix", "start", "stop")
    late = a.withColumn("start", (F.col("start") - 1.85) / 1.0034).withColumn("stop", (F.col("stop") - 1.85) / 1.0034)
    x = AL.drift(a, late, KEY)
    return x.select("track_id", F.round("scale", 6).alias("scale"), F.round("shift", 4).alias("shift"), F.round("correlation", 6).alias("correlation"), "refined")


def grid_sql(kind: str, ref: str, probe: str) -> str:
    """A whole query: the chosen ratio of each pair (track_id, scale, lag, correlation, peak_ratio), of presence or onset signals."""
    keys = "track_id, scale_ix"
    grid = ", ".join(f"({k}, CAST({v!r} AS DOUBLE))" for k, v in enumerate(C.SCALES))
    return f"""WITH grid(scale_ix, scale) AS (VALUES {grid}), scaled AS (SELECT p.*, scale_ix, scale FROM {probe} p CROSS JOIN grid),
na AS (SELECT track_id, scale_ix, n_bins FROM {ref}_n CROSS JOIN grid), nb AS ({length_sql('scaled', 'scale', keys)}), ra AS (SELECT track_id, scale_ix, s, e FROM {ref} CROSS JOIN grid),
pb AS ({clip_sql(merge_sql(bins_sql('scaled', kind, 'scale', ', scale_ix'), keys), 'SELECT * FROM nb', keys)}), {correlate_sql(keys)},
top AS (SELECT track_id, arg_max(scale_ix, {{'c': correlation, 'n': -scale_ix}}) AS tix, max(correlation) AS tcorr, max(CASE WHEN scale_ix = 0 THEN correlation END) AS pcorr FROM fits GROUP BY track_id)
SELECT f.track_id, scale, lag, correlation, peak_ratio FROM fits f JOIN grid USING (scale_ix) JOIN top t ON f.track_id = t.track_id AND f.scale_ix = CASE WHEN tcorr - pcorr < 0.02 THEN 0 ELSE tix END"""


def cover_sql(probe: str) -> str:
    """A whole query: (track_id, covered, shown) of a probe already moved, against tracks: shares of reference starts near one of its own, and of time."""
    return f"""SELECT n.track_id, CAST(coalesce(c, 0) AS DOUBLE) / n AS covered, shown FROM (SELECT track_id, count(*) AS n FROM tracks GROUP BY track_id) n
 JOIN (SELECT track_id, least(sum(stop_s - start_s) / (CAST(max(n_bins) AS DOUBLE) / 100.0), 1.0) AS shown FROM {probe} JOIN over_n USING (track_id) GROUP BY track_id) USING (track_id)
 LEFT JOIN (SELECT track_id, count(*) AS c FROM tracks t WHERE EXISTS (SELECT 1 FROM {probe} p WHERE p.track_id = t.track_id AND abs(p.start_s - t.start_s) <= 0.5) GROUP BY track_id) USING (track_id)"""


def verdict_sql(probe: str) -> str:
    """WITH clauses (of WITH RECURSIVE) from tracks and a probe table (track_id, src_ix, start_s, stop_s, stop_s > start_s) to verdicts: all steps for all pairs, by the default settings."""
    fit = "track_id, lag / 100.0::DOUBLE AS shift, scale, correlation, peak_ratio"
    return f"""over_n AS MATERIALIZED ({length_sql('tracks')}), over AS MATERIALIZED ({clip_sql(merge_sql(bins_sql('tracks')), 'SELECT * FROM over_n')}),
onset_n AS MATERIALIZED (SELECT track_id, CAST(ceil(CAST(n_bins AS DOUBLE) / 100.0 * 100.0) AS BIGINT) + 2 AS n_bins FROM over_n), onset_s AS MATERIALIZED ({clip_sql(merge_sql(bins_sql('tracks', 'onset')), 'SELECT * FROM onset_n')}),
enough AS MATERIALIZED (SELECT * FROM {probe} SEMI JOIN (SELECT track_id FROM {probe} GROUP BY track_id HAVING count(*) >= {C.MIN_CUES_TO_ALIGN}) USING (track_id)),
onset_s_n AS (SELECT * FROM onset_n), both_fits AS MATERIALIZED (SELECT FALSE AS onset, CAST(0.5 AS DOUBLE) AS lo, {fit} FROM ({grid_sql('presence', 'over', 'enough')}) UNION ALL SELECT TRUE, CAST(0.25 AS DOUBLE), {fit} FROM ({grid_sql('onset', 'onset_s', 'enough')})),
best_rep AS MATERIALIZED (SELECT * FROM both_fits QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY correlation >= lo AND peak_ratio >= 1.2 DESC, least(correlation / lo, peak_ratio / 1.2) DESC, onset) = 1),
own_ref AS MATERIALIZED (SELECT track_id, s, e FROM over SEMI JOIN (FROM best_rep WHERE NOT onset) USING (track_id) UNION ALL SELECT track_id, s, e FROM onset_s SEMI JOIN (FROM best_rep WHERE onset) USING (track_id)),
own_ref_n AS MATERIALIZED (SELECT track_id, n_bins FROM over_n SEMI JOIN (FROM best_rep WHERE NOT onset) USING (track_id) UNION ALL SELECT track_id, n_bins FROM onset_n SEMI JOIN (FROM best_rep WHERE onset) USING (track_id)),
coarse AS (SELECT track_id, onset, scale, shift, correlation, peak_ratio FROM best_rep), {refine_sql('own_ref', 'enough', 'coarse')},
placed_probe AS MATERIALIZED (SELECT track_id, src_ix, scale * start_s + shift AS start_s, scale * stop_s + shift AS stop_s FROM enough JOIN refined USING (track_id)),
fitted AS MATERIALIZED (SELECT r.track_id, r.onset, lo, r.scale, r.shift, r.correlation, r.peak_ratio, covered, shown, r.correlation >= lo AND r.peak_ratio >= 1.2 AS good FROM refined r JOIN best_rep b USING (track_id) LEFT JOIN ({cover_sql('placed_probe')}) USING (track_id)),
routed AS MATERIALIZED (SELECT e.*, CAST(round_even(shift * 100, 0) AS BIGINT) AS centre FROM enough e JOIN fitted USING (track_id) WHERE NOT good), na AS (SELECT * FROM over_n), ra AS (SELECT * FROM over),
{piecewise_sql('routed', 'centre')}, several AS (SELECT track_id, count(*) AS n_blocks, min(last_cue - first_cue + 1) AS least_cues FROM split_blocks GROUP BY track_id HAVING count(*) > 1),
cuts AS (SELECT track_id, n_blocks, split_correlation, c.covered AS c2, c.shown AS o2 FROM several JOIN split_fits USING (track_id) JOIN ({cover_sql('shifted')}) c USING (track_id) JOIN fitted f USING (track_id)
 WHERE n_blocks <= 4 AND least_cues >= 10 AND split_correlation >= lo AND split_correlation > f.correlation + 0.05 AND c.covered >= 0.65 AND c.covered > f.covered + 0.10),
verdicts AS (SELECT track_id, CASE WHEN f.track_id IS NULL THEN 'Declined' WHEN c.n_blocks IS NOT NULL THEN 'PiecewiseCut' WHEN NOT good THEN 'Declined' WHEN abs(scale - 1) > 1e-9 THEN (CASE WHEN abs(scale - 1) > 0.1 THEN 'Declined' ELSE 'FramerateDrift' END)
 WHEN abs(shift) > 30 THEN 'Declined' WHEN abs(shift) < 0.15 THEN 'Exact' ELSE 'ConstantOffset' END AS verdict, f.scale, f.shift, f.correlation, peak_ratio, covered, shown, CASE WHEN f.track_id IS NOT NULL THEN CASE WHEN onset THEN 'onsets' ELSE 'overlap' END END AS matched_on,
 n_blocks, split_correlation, c2, o2 FROM (SELECT DISTINCT track_id FROM {probe}) LEFT JOIN fitted f USING (track_id) LEFT JOIN cuts c USING (track_id))"""


_SAID = """SELECT track_id, verdict, round(CASE WHEN matched_on IS NULL OR verdict = 'Exact' THEN 1.0 ELSE scale END, 6) AS scale, round(CASE WHEN matched_on IS NULL OR verdict = 'Exact' THEN 0.0 ELSE shift END, 4) AS shift,
 round(coalesce(split_correlation, correlation, 0.0), 6) AS correlation, round(coalesce(peak_ratio, 0.0), 6) AS ratio, round(coalesce(c2, covered), 6) AS coverage, round(coalesce(o2, shown), 6) AS on_screen, matched_on, CAST(coalesce(n_blocks, 0) AS INT) AS n_blocks FROM verdicts"""


def _said(x):
    places = {"scale": 6, "shift": 4, "correlation": 6, "ratio": 6, "coverage": 6, "on_screen": 6}
    return x.select("track_id", "verdict", *[F.round(c, n).alias(c) for c, n in places.items()], "matched_on", "n_blocks")


@query(f"WITH RECURSIVE {TRACKS}, {PROBES}, {verdict_sql('probes')} {_SAID}")
def align_verdicts(spark, sf_dir):
    a = tracks(spark, sf_dir)
    return _said(AL.align(a.select("track_id", "src_ix", "start", "stop"), probes(a).select("track_id", "src_ix", "start", "stop"), KEY))


#: Seven kinds of probe: in time, late, another rate, cut, another track's, few cues, slowly drifting.
_KINDS = """kinds AS (SELECT track_id, src_ix, CASE track_id % 7 WHEN 0 THEN start_s + 0.04::DOUBLE WHEN 1 THEN start_s + 4.2::DOUBLE WHEN 2 THEN start_s * 0.96::DOUBLE WHEN 3 THEN start_s + CASE WHEN start_s < 700 THEN 2.0::DOUBLE ELSE 9.0::DOUBLE END WHEN 6 THEN (start_s - 1.85::DOUBLE) / 1.0034::DOUBLE ELSE start_s END AS start_s,
 CASE track_id % 7 WHEN 0 THEN stop_s + 0.04::DOUBLE WHEN 1 THEN stop_s + 4.2::DOUBLE WHEN 2 THEN stop_s * 0.96::DOUBLE WHEN 3 THEN stop_s + CASE WHEN start_s < 700 THEN 2.0::DOUBLE ELSE 9.0::DOUBLE END WHEN 6 THEN (stop_s - 1.85::DOUBLE) / 1.0034::DOUBLE ELSE stop_s END AS stop_s FROM tracks WHERE track_id % 7 <> 4 AND (track_id % 7 <> 5 OR src_ix % 25 = 0)
 UNION ALL SELECT track_id - 1, src_ix, start_s, stop_s FROM tracks WHERE (track_id - 1) % 7 = 4)"""


@query(f"WITH RECURSIVE {TRACKS}, {_KINDS}, {verdict_sql('kinds')} {_SAID}")
def verdict_kinds(spark, sf_dir):
    """Tracks against probes of every kind that a verdict tells apart."""
    t = tracks(spark, sf_dir).select("track_id", "src_ix", "start", "stop")
    k = F.col("track_id") % 7
    cut = F.when(F.col("start") < 700, 2.0).otherwise(9.0)
    at = lambda c: F.when(k == 0, F.col(c) + 0.04).when(k == 1, F.col(c) + 4.2).when(k == 2, F.col(c) * 0.96).when(k == 3, F.col(c) + cut).when(k == 6, (F.col(c) - 1.85) / 1.0034).otherwise(F.col(c))
    own = t.where((k != 4) & ((k != 5) | (F.col("src_ix") % 25 == 0))).select("track_id", "src_ix", at("start").alias("start"), at("stop").alias("stop"))
    other = t.where((F.col("track_id") - 1) % 7 == 4).select((F.col("track_id") - 1).alias("track_id"), "src_ix", "start", "stop")
    return _said(AL.align(t, own.unionByName(other), KEY))


def floor_sql(frames: str, key: str) -> str:
    """WITH clauses (of WITH RECURSIVE) from frames (key, frame_no from 0 on without gaps, energy) to floors, frame by frame."""
    return f"""floors({key}, frame_no, floor) AS (SELECT DISTINCT {key}, -1::BIGINT, {FL.FIRST}::DOUBLE FROM {frames} UNION ALL
 SELECT w.{key}, f.frame_no, CASE WHEN energy <= 0 THEN floor WHEN energy < floor THEN (1 - {FL.FALL}::DOUBLE) * floor + {FL.FALL}::DOUBLE * energy ELSE (1 - {FL.RISE}::DOUBLE) * floor + {FL.RISE}::DOUBLE * energy END
 FROM floors w JOIN {frames} f ON f.{key} = w.{key} AND f.frame_no = w.frame_no + 1)"""


_SCORE = "CASE WHEN energy > 0 THEN greatest(0.0, least(1.0, 0.6 * greatest(0.0, least(1.0, log10(energy / greatest(floor, 1e-12)) / 1.5)) + 0.4 * greatest(0.0, least(1.0, (0.5 - flatness) / 0.35)))) ELSE 0.0 END"


@query(f"""WITH RECURSIVE f AS MATERIALIZED (SELECT event_type AS kind, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS frame_no, CASE WHEN event_id % 17 = 0 THEN 0.0 ELSE value * value / 50000.0 END AS energy, CAST(user_id % 10 AS DOUBLE) / 10.0 AS flatness FROM events),
{floor_sql('f', 'kind')} SELECT kind, frame_no, round(floor, 9) AS floor, round({_SCORE}, 9) AS score FROM f JOIN floors USING (kind, frame_no)""")
def noise_floor(spark, sf_dir):
    """The events of each type as one long track of frames, in blocks of 64."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events")
    no = (F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1).cast("long")
    energy = F.when(F.col("event_id") % 17 == 0, 0.0).otherwise(F.col("value") * F.col("value") / 50000.0)
    f = e.select(F.col("event_type").alias("kind"), no.alias("frame_no"), energy.alias("energy"), ((F.col("user_id") % 10) / 10.0).alias("flatness"))
    x = f.join(FL.floors(f, ["kind"], 64), ["kind", "frame_no"])
    return x.select("kind", "frame_no", F.round("floor", 9).alias("floor"), F.round(V.score(F.col("energy"), F.col("flatness"), F.col("floor")), 9).alias("score"))


@query(f"""WITH RECURSIVE {TRACKS}, kinds AS (SELECT unnest([0.01::DOUBLE, 0.5::DOUBLE]) AS a),
samples AS (SELECT a, k, (sin(k * 0.3::DOUBLE) * a + sin(k * 1.7::DOUBLE) * 0.01::DOUBLE) * (0.5 - 0.5 * cos(2 * pi() * k / 511)) AS x FROM kinds CROSS JOIN (SELECT unnest(range(0, 512)) AS k)),
power AS (SELECT a, j, pow(sum(x * cos(2 * pi() * j * k / 512)), 2) + pow(sum(x * sin(2 * pi() * j * k / 512)), 2) AS p FROM samples CROSS JOIN (SELECT unnest(range({V.FIRST_BIN}, {V.LAST_BIN + 1})) AS j) GROUP BY a, j),
spectra AS (SELECT a, sum(p) AS energy, exp(avg(ln(p + 1e-12))) / greatest(avg(p), 1e-300) AS flatness FROM power GROUP BY a),
f AS MATERIALIZED (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY sb, src_ix) - 1 AS frame_no, energy, flatness FROM tracks JOIN spectra ON a = CASE WHEN event_type = 'error' THEN 0.01::DOUBLE ELSE 0.5::DOUBLE END),
{floor_sql('f', 'track_id')} SELECT track_id, frame_no, round({_SCORE}, 6) AS score FROM f JOIN floors USING (track_id, frame_no)""")
def vad_energy(spark, sf_dir):
    """Frames made of bursts at each cue: 32 ms frames of a tone that is loud while a cue is on."""
    t = tracks(spark, sf_dir)
    loud = F.when(F.col("event_type") == "error", 0.01).otherwise(0.5)
    samples = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda k: F.sin(k * 0.3) * F.col("_a") + F.sin(k * 1.7) * 0.01)
    frames = I.ordered(t, KEY).withColumn("_a", loud).select("track_id", F.col("cue_ix").alias("frame_no"), samples.alias("samples"))
    return V.scores(frames, "track_id").withColumn("score", F.round("score", 6))
