"""Piecewise program, drift refinement, verdicts and noise floor of many pairs at once, against plain loops over each."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from intervane import config as C
from intervane.operators import align as AL
from intervane.operators import floor as FL
from intervane.operators import piecewise as PW
from intervane.operators import vad as V
from tests import plain as K

CUES = "k long, src_ix long, start double, stop double"


def episode(r, n):
    t, s, e = 12.0, [], []
    for _ in range(n):
        d = r.uniform(0.8, 4)
        s.append(round(t, 3))
        e.append(round(t + d, 3))
        t += d + r.uniform(0.3, 3.3)
    return np.array(s), np.array(e)


def rows(pairs, which, more=()):
    return [(k, i, float(a), float(b), *(p[m] for m in more)) for k, p in pairs.items() for i, (a, b) in enumerate(zip(p[which], p[which + 1]))]


def test_piecewise_program_equals_the_dense_loop(spark):
    r = np.random.default_rng(5)
    pairs, refs, probes = {}, [], []
    for k in range(200):
        n, t, s, e = int(r.integers(3, 60)), float(r.uniform(-5, 20)), [], []
        for _ in range(n):
            d = float(r.uniform(0.0, 4))
            s.append(round(t, 3))
            e.append(round(t + d, 3))
            t += d * float(r.uniform(0.5, 1)) + float(r.uniform(0, 3))
        off = np.where(np.array(s) < t / 2, r.uniform(-20, 20), r.uniform(-20, 20)) if k % 2 else np.full(n, r.uniform(-25, 25))
        keep, order = r.random(n) < 0.9, None
        ps, pe = (np.array(s) - off + r.normal(0, 0.05, n))[keep], (np.array(e) - off)[keep]
        order = r.permutation(len(ps))
        pairs[k] = (np.array(s), np.array(e), ps[order], pe[order], float(r.choice([0.0, 3.3, -7.125])))
        refs += [(k, i, a, b) for i, (a, b) in enumerate(zip(s, e))]
        probes += [(k, i, float(a), float(b)) for i, (a, b) in enumerate(zip(ps[order], pe[order]))]
    probes += [(900, 0, 1.0, 2.0)]
    refs += [(901, 0, 1.0, 2.0), (902, 0, -9.0, -8.0)]
    probes += [(902, 0, 1.0, 2.0)]
    centre = spark.createDataFrame([(k, p[4]) for k, p in pairs.items()], "k long, centre double")
    out = PW.split(spark.createDataFrame(refs, CUES), spark.createDataFrame(probes, CUES), ["k"], centre)
    got = {x.k: (x.correlation, [tuple(b) for b in x.blocks]) for x in out.collect()}
    assert got.pop(902) == (0.0, [])
    several = 0
    for k, (s, e, ps, pe, c) in pairs.items():
        track, probe = K.track(s, e), K.track(ps, pe)
        if len(track[0]) and len(probe[0]):
            blocks, corr = K.split(K.presence(*track), *probe, c)
            score, found = got.pop(k)
            assert found == blocks and score == pytest.approx(corr, abs=1e-12)
            several += len(blocks) > 1
    assert not got and several > 40


def test_ratings_equal_counting_bins():
    r = np.random.default_rng(2)
    bins = r.random(500) < 0.4
    s, e = np.nonzero(np.diff(bins.astype(int), prepend=0) == 1)[0], np.nonzero(np.diff(bins.astype(int), append=0) == -1)[0] + 1
    at = lambda x, y: sum(bins[i] for i in range(max(x, 0), max(0, min(y, 500))))
    for a, b, g, first in ((100, 140, 40, -30), (0, 1, 1, -200), (480, 700, 200, -10)):
        want = [4 * at(a + o, b + o) - at(a + o - g, a + o) - at(b + o, b + o + g) for o in range(first, first + 60)]
        assert PW.rating(s, e, a, b, g, first, 60).tolist() == want


def test_drift_equals_the_plain_loop(spark):
    r = np.random.default_rng(9)
    pairs = {}
    for k in range(24):
        s, e = episode(r, int(r.integers(10, 160)))
        f = 1 + float(r.choice([0.0, 0.0034, -0.002, 0.0008, 0.03]))
        late = float(r.uniform(-9, 9))
        pairs[k] = (s, e, (s - late) / f, (e - late) / f)
    pairs[50] = (*episode(r, 90), *episode(r, 90))
    out = AL.drift(spark.createDataFrame(rows(pairs, 0), CUES), spark.createDataFrame(rows(pairs, 2), CUES), ["k"])
    got = {x.k: x for x in out.collect()}
    for k, (s, e, ps, pe) in pairs.items():
        ref = K.presence(s, e)
        coarse = K.search(ref, ps, pe, (1.0,))[0]
        better = K.refine(ref, ps, pe, coarse, False)
        want = better or coarse
        assert got[k].refined == (better is not None)
        assert (got[k].scale, got[k].shift, got[k].correlation) == pytest.approx((want.scale, want.offset, want.correlation), abs=1e-7)
    assert sum(x.refined for x in got.values()) > 8


def verdict_pairs():
    r = np.random.default_rng(7)
    pairs = {}
    for k in range(32):
        s, e = episode(r, int(r.integers(60, 130)))
        cut = np.where(s < s[-1] / 2, 2.0, 9.0)
        ps, pe = [(s - 0.05, e - 0.05), (s - 7.3, e - 7.3), ((s - 1) * 0.96, (e - 1) * 0.96), (s - cut, e - cut), episode(r, 80), (s[:3], e[:3]), ((s - 1.85) / 1.0034, (e - 1.85) / 1.0034), (s - 45.0, e - 45.0)][k % 8]
        pairs[k] = (*((s, e) if k != 17 else (s[:0], e[:0])), ps, pe, k % 5 == 0, k % 3 == 0)
    return pairs


@pytest.mark.parametrize("settings", [C.DEFAULTS, C.Settings(decline_karaoke=True, framerate=False, max_offset=5.0), C.Settings(allow_piecewise=False, decline_karaoke=True, max_scale_deviation=0.01)])
def test_verdicts_equal_the_plain_loop(spark, settings):
    pairs = verdict_pairs()
    probe = spark.createDataFrame(rows(pairs, 2, (4, 5)), CUES + ", different_cut boolean, karaoke boolean")
    got = {x.k: x for x in AL.align(spark.createDataFrame(rows(pairs, 0), CUES), probe, ["k"], settings).collect()}
    assert got.keys() == pairs.keys()
    for k, (s, e, ps, pe, cut, karaoke) in pairs.items():
        want, x = K.align(s, e, ps, pe, different_cut=cut, karaoke=karaoke, settings=settings), got[k]
        assert (x.verdict, x.matched_on, x.reason, x.n_blocks) == (want["verdict"], want["matched_on"], want["reason"], len(want["blocks"]))
        assert [tuple(b) for b in x.blocks] == want["blocks"]
        for c in ("scale", "shift", "correlation", "ratio", "coverage", "on_screen"):
            assert x[c] == (want[c] if want[c] is None else pytest.approx(want[c], abs=1e-6))
    if settings is C.DEFAULTS:
        assert {x.verdict for x in got.values()} == {"Exact", "ConstantOffset", "FramerateDrift", "PiecewiseCut", "Declined"}


def test_floor_equals_the_fold(spark):
    r = random.Random(3)
    tracks = {k: [r.choice([0.0, 10 ** r.uniform(-7, 3)]) if k else 10 ** r.uniform(-3, 0) for _ in range(n)] for k, n in enumerate((900, 1, 63, 64, 65, 300))}
    frames = spark.createDataFrame([(k, i, e) for k, x in tracks.items() for i, e in enumerate(x)], "k long, frame_no long, energy double").repartition(5)
    got = {(x.k, x.frame_no): x.floor for x in FL.floors(frames, ["k"], 16).collect()}
    assert len(got) == sum(map(len, tracks.values()))
    for k, x in tracks.items():
        floor = FL.FIRST
        for i, e in enumerate(x):
            if e > 0:
                rate = FL.FALL if e < floor else FL.RISE
                floor = (1 - rate) * floor + rate * e
            assert got[k, i] == pytest.approx(floor, rel=1e-12)
    assert FL.block_maps(frames.where("k = 0"), ["k"], 16).count() == 57  # one track, many tasks


def test_maps_compose_in_any_grouping():
    r = random.Random(1)
    maps = [FL.frame_map(10 ** r.uniform(-4, 1)) for _ in range(40)]
    left = FL.Bent()
    for m in maps:
        left = left.then(m)
    halves = [FL.Bent(), FL.Bent()]
    for i, m in enumerate(maps):
        halves[i >= 17] = halves[i >= 17].then(m)
    both = halves[0].then(halves[1])
    for f in (0.0, 1e-6, 0.01, 3.0, 50.0):
        want = f
        for m in maps:
            want = float(m(want))
        assert float(left(f)) == pytest.approx(want, rel=1e-12) and float(both(f)) == pytest.approx(want, rel=1e-12)


def test_scores_of_silence_and_short_frames(spark):
    frames = spark.createDataFrame([(1, 0, None), (1, 1, [0.0] * 512), (1, 2, [0.5, -0.5] * 10), (1, 3, [])], "k int, frame_no int, samples array<double>")
    got = {x.frame_no: x.score for x in V.scores(frames, "k").collect()}
    assert got[0] == got[1] == got[3] == 0.0 and 0 < got[2] <= 1
    assert V.scores(frames.limit(0), "k").agg(F.count("*")).first()[0] == 0


def test_maps_of_many_blocks_equal_composing_frame_by_frame(spark):
    r = np.random.default_rng(1)
    energy = r.choice([0.0, 1.0, 1.0], size=(40, 30)) * np.exp(r.normal(0, 3, (40, 30)))
    energy[3], energy[4], energy[5, ::2] = 0.0, 2.0, 3.0
    for row, got in zip(energy, FL.composed(energy)):
        want = FL.Bent()
        for e in row:
            want = want.then(FL.frame_map(e))
        at = np.exp(r.normal(0, 4, 60))
        assert got(at) == pytest.approx(want(at), rel=1e-12) and len(got.x) == len(want.x)
    # blocks are not Python groups of their own, and spectra, which cost most, are found once
    frames = spark.createDataFrame([(0, i, float(i % 7)) for i in range(90)], "k int, frame_no long, energy double")
    assert "FlatMapGroupsInPandas" not in FL.floors(frames, ["k"], 16)._jdf.queryExecution().executedPlan().toString()
    sound = frames.select("k", "frame_no", F.array(F.lit(0.1), F.lit(0.3)).alias("samples"))
    assert "samples" not in V.scores(sound, "k")._jdf.queryExecution().executedPlan().toString()
