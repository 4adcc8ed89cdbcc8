"""Distort-and-recover tests of the plain loops that the operators are held against, on synthetic episodes."""

import numpy as np
import pytest

from intervane import config as C
from tests import plain as K


def episode(seed, n=280):
    r = np.random.default_rng(seed)
    t, s, e = 12.0, [], []
    for _ in range(n):
        d = r.uniform(0.8, 4.0)
        s.append(t)
        e.append(t + d)
        t += d + r.uniform(0.3, 3.3)
    return np.array(s), np.array(e)


def brute(ref, probe, limit):
    out = []
    for lag in range(-limit, limit + 1):
        idx = np.nonzero(probe)[0] + lag
        idx = idx[(idx >= 0) & (idx < len(ref))]
        out.append(int(ref[idx].sum()))
    return np.array(out)


def test_overlaps_equal_brute_force_both_ways(monkeypatch):
    r = np.random.default_rng(3)
    ref, probe = r.random(900) < 0.4, r.random(700) < 0.3
    want = brute(ref, probe, 120)
    assert (K.overlaps(ref, probe, 120) == want).all()
    monkeypatch.setattr(K, "_EDGE_PRODUCTS", 0)
    assert (K.overlaps(ref, probe, 120) == want).all()


@pytest.mark.parametrize("shift", [-12.34, 0.0, 7.5, 29.0])
def test_constant_shift_is_recovered(shift):
    s, e = episode(1)
    v = K.align(s, e, s - shift, e - shift)
    assert v["shift"] == pytest.approx(shift, abs=0.011) and v["correlation"] > 0.95
    assert v["verdict"] == ("Exact" if shift == 0 else "ConstantOffset")


def test_right_and_wrong_episodes_separate_over_seeds():
    right, wrong = [], []
    for seed in range(20):
        s, e = episode(seed)
        o, p = episode(seed + 1000)
        ref = K.presence(s, e)
        f, g = K.search(ref, s + 2, e + 2, (1.0,))[0], K.search(ref, o, p, (1.0,))[0]
        right.append((f.correlation, f.ratio))
        wrong.append((g.correlation, g.ratio))
    assert min(x[0] for x in right) > max(x[0] for x in wrong) and min(x[1] for x in right) > max(x[1] for x in wrong)
    assert max(x[0] for x in wrong) < 0.45


def test_wrong_episode_is_declined():
    assert K.align(*episode(1), *episode(77))["verdict"] == "Declined"


def test_frame_rate_is_recovered():
    s, e = episode(5)
    v = K.align(s, e, s * 0.96, e * 0.96)
    assert v["verdict"] == "FramerateDrift" and v["scale"] == pytest.approx(25 / 24, abs=1e-4)


def test_slow_drift_is_refined():
    r = np.random.default_rng(9)
    t, s, e = 5.0, [], []
    while t < 1420:
        d = r.uniform(1, 3)
        s.append(t)
        e.append(t + d)
        t += d + r.uniform(2, 10)
    s, e = np.array(s), np.array(e)
    late = lambda x: x - (1.85 + (6.7 - 1.85) * x / 1420)
    v = K.align(s, e, late(s), late(e))
    assert v["verdict"] == "FramerateDrift" and v["coverage"] > 0.95


def test_cut_gives_two_blocks():
    s, e = episode(2)
    off = np.where(s < 480, 2.0, 9.0)
    blocks, corr = K.split(K.presence(s, e), s - off, e - off, 0.0)
    assert [round(b[2], 2) for b in blocks] == [2.0, 9.0] and corr > 0.95
    assert blocks[0][0] == 0 and blocks[1][1] == len(s) - 1


def test_too_few_cues_are_declined():
    s, e = episode(3)
    assert K.align(s, e, s[:4], e[:4])["verdict"] == "Declined"


def test_phi_is_zero_where_undefined():
    assert K.phi(1, 0, 5, 10) == 0 and K.phi(1, 10, 5, 10) == 0 and K.phi(0, 0, 0, 0) == 0


def test_length_takes_the_last_starting_cue():
    s, e = K.track([0.0, 5.0], [20.0, 6.0])
    assert K.length_of(e) == 602 and len(K.presence(s, e)) == 602


def test_zero_length_cue_is_one_bin_and_long_ones_are_cut():
    sig = K.presence(np.array([1.0, 3.0]), np.array([1.001, 30.0]))
    assert sig[100] and sig[:200].sum() == 1 and sig.sum() == 1 + round(C.MAX_CUE * C.BINS)
