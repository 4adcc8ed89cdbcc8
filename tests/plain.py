"""Plain loops over one pair, against which the operators are held. All take cue arrays in seconds, ordered by start."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from intervane import config as C


def track(starts, ends) -> tuple[np.ndarray, np.ndarray]:
    """Cues with end > start, in stable order of start."""
    s, e = np.asarray(starts, float), np.asarray(ends, float)
    keep = e > s
    s, e = s[keep], e[keep]
    order = np.argsort(s, kind="stable")
    return s[order], e[order]


def _paint(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    a, b = np.clip(a, 0, n), np.clip(b, 0, n)
    use = b > a
    np.add.at(step, a[use], 1)
    np.add.at(step, b[use], -1)
    return np.cumsum(step)[:n] > 0


def length_of(e: np.ndarray, total: float = 0.0, scale: float = 1.0) -> int:
    """Bins of a signal: the end of the last-starting cue decides, not the latest end."""
    span = total if total > 0 else (e[-1] * scale if len(e) else 0.0)
    return max(2, math.ceil(span * C.BINS) + 2)


def presence(s, e, total=0.0, scale=1.0, max_cue=C.MAX_CUE) -> np.ndarray:
    start = s * scale
    stop = np.minimum(e * scale, start + max_cue)
    a = np.rint(start * C.BINS).astype(np.int64)
    b = np.maximum(np.rint(stop * C.BINS).astype(np.int64), a + 1)
    return _paint(a, b, length_of(e, total, scale))


def onsets(s, e, total=0.0, scale=1.0) -> np.ndarray:
    a = np.rint(s * scale * C.BINS).astype(np.int64)
    return _paint(a, a + max(1, round(C.PULSE * C.BINS)), length_of(e, total, scale))


def phi(overlap: float, a: float, b: float, n: float) -> float:
    """Overlap beyond chance, as a phi coefficient; 0 where it is undefined."""
    if n <= 0 or a <= 0 or b <= 0 or a >= n or b >= n:
        return 0.0
    spread = a * (1 - a / n) * b * (1 - b / n)
    return (overlap - a * b / n) / math.sqrt(spread) if spread > 0 else 0.0


#: Products of edges up to which the lags are counted edge by edge; beyond, a transform is cheaper.
_EDGE_PRODUCTS = 4_000_000


def _edges(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.concatenate([[False], x, [False]]).astype(np.int8))
    at = np.nonzero(step)[0]
    return at, step[at].astype(np.int64)


def overlaps(ref: np.ndarray, probe: np.ndarray, limit: int) -> np.ndarray:
    """Exact overlap at each lag of the probe in [-limit, limit]."""
    (xa, wa), (xb, wb) = _edges(ref), _edges(probe)
    if len(xa) * len(xb) <= _EDGE_PRODUCTS:
        lag, w = (xa[:, None] - xb[None, :]).ravel(), -(wa[:, None] * wb[None, :]).ravel()
        w, lag = w[lag <= limit], lag[lag <= limit]
        low = lag < -limit
        slope = np.cumsum(np.bincount(np.maximum(lag, -limit) + limit, w, 2 * limit + 1))
        start = float((w[low] * (-limit - lag[low])).sum())
        return np.rint(start + np.concatenate([[0.0], np.cumsum(slope[:-1])])).astype(np.int64)
    n = 1 << (max(len(ref), len(probe)) + limit).bit_length()
    wave = np.fft.irfft(np.fft.rfft(ref.astype(float), n) * np.conj(np.fft.rfft(probe.astype(float), n)), n)
    return np.rint(wave[np.arange(-limit, limit + 1) % n]).astype(np.int64)


def correlate(ref: np.ndarray, probe: np.ndarray, max_lag: int, guard: int) -> tuple[int, int, float, float]:
    """(lag, overlap, correlation, ratio to the second peak): integer overlaps, ties to the most negative lag."""
    v, lags = overlaps(ref, probe, max_lag), np.arange(-max_lag, max_lag + 1)
    k = int(np.argmax(v))
    if v[k] <= 0:
        return 0, 0, 0.0, 0.0
    second = int(v[np.abs(lags - lags[k]) > guard].max(initial=0))
    return int(lags[k]), int(v[k]), phi(v[k], int(ref.sum()), int(probe.sum()), max(len(ref), len(probe))), (v[k] / second if second > 0 else C.NO_SECOND_PEAK)


@dataclass
class Fit:
    scale: float
    offset: float
    correlation: float
    ratio: float


def search(ref: np.ndarray, s, e, scales=C.SCALES, onset=False, settings=C.DEFAULTS, max_search=None) -> list[Fit]:
    """Fits of each ratio by correlation; unscaled first if within the margin of the best."""
    if not len(s) or not ref.any():
        return []
    lag, guard = round((max_search if max_search is not None else settings.max_search) * C.BINS), round(settings.peak_guard * C.BINS)
    fits = []
    for scale in scales:
        sig = onsets(s, e, scale=scale) if onset else presence(s, e, scale=scale)
        at, _, corr, ratio = correlate(ref, sig, lag, guard)
        fits.append(Fit(scale, at / C.BINS, corr, ratio))
    fits.sort(key=lambda f: -f.correlation)
    plain = next((f for f in fits if abs(f.scale - 1) <= 1e-9), None)
    if plain and fits[0] is not plain and abs(fits[0].scale - 1) > 1e-9 and fits[0].correlation - plain.correlation < settings.scale_margin:
        fits.remove(plain)
        fits.insert(0, plain)
    return fits


def refine(ref: np.ndarray, s, e, coarse: Fit, onset: bool, settings=C.DEFAULTS) -> Fit | None:
    """Scale and offset from the residual shifts of the front and back of the track, while the correlation grows."""
    best, now = None, coarse
    for _ in range(C.DRIFT_PASSES):
        n = int(len(s) * C.DRIFT_FRACTION)
        if n < C.DRIFT_MIN_CUES:
            break
        cs, ce = track(now.scale * s + now.offset, now.scale * e + now.offset)
        ends = []
        for part in (slice(0, n), slice(len(cs) - n, len(cs))):
            f = search(ref, cs[part], ce[part], (1.0,), onset, settings)
            ends.append((f[0].offset, float(cs[part].mean())) if f and len(cs[part]) >= C.DRIFT_MIN_CUES else None)
        if None in ends:
            break
        (r0, t0), (r1, t1) = ends
        if t1 - t0 < C.DRIFT_MIN_SPAN or abs(r1 - r0) < C.DRIFT_DISAGREEMENT:
            break
        extra = 1 + (r1 - r0) / (t1 - t0)
        if abs(extra - 1) > C.DRIFT_MAX_DEVIATION:
            break
        scale, offset = now.scale * extra, now.offset * extra + r0 - (extra - 1) * t0
        check = search(ref, *track(scale * s + offset, scale * e + offset), (1.0,), onset, settings)
        if not check or check[0].correlation <= now.correlation:
            break
        best = now = Fit(scale, offset, check[0].correlation, check[0].ratio)
    return best


def split(ref: np.ndarray, s, e, centre: float) -> tuple[list[tuple[int, int, float]], float]:
    """(blocks of (first cue, last cue, offset), correlation): the best path over offsets, where each change costs a penalty.

    Row by row over all offsets at once; flags of jumps, one byte a cue and offset, lead back.
    """
    n = len(s)
    if not n or not ref.any():
        return [], 0.0
    radius = round(C.SPLIT_RADIUS * C.BINS)
    first = round(centre * C.BINS) - radius
    offsets = np.arange(first, first + 2 * radius + 1)
    total = np.concatenate([[0], np.cumsum(ref)])
    upto = lambda x: total[np.clip(x, 0, len(ref))]
    a = np.rint(s * C.BINS).astype(np.int64)
    b = np.maximum(a + 1, np.rint(e * C.BINS).astype(np.int64))
    guard = np.minimum(b - a, C.SPLIT_GUARD)

    def rate(i: int) -> np.ndarray:
        x, y, g = a[i] + offsets, b[i] + offsets, guard[i]
        return (upto(y) - upto(x)) - C.SPLIT_LENGTH_PENALTY * ((upto(x) - upto(x - g)) + (upto(y + g) - upto(y)))

    score, jumped, source = rate(0), np.zeros((n, len(offsets)), bool), np.zeros(n, np.int64)
    for i in range(1, n):
        source[i] = k = int(np.argmax(score))
        leap = score[k] - C.SPLIT_PENALTY * C.BINS
        jumped[i] = leap > score
        score = rate(i) + np.maximum(score, leap)
    at, path = int(np.argmax(score)), np.zeros(n, np.int64)
    for i in range(n - 1, -1, -1):
        path[i] = offsets[at]
        if i and jumped[i, at]:
            at = int(source[i])
    turn = np.concatenate([[0], np.nonzero(np.diff(path))[0] + 1, [n]])
    blocks = [(int(x), int(y) - 1, float(path[x]) / C.BINS) for x, y in zip(turn[:-1], turn[1:])]
    ms, me = track(s + path / C.BINS, e + path / C.BINS)
    sig = presence(ms, me, (len(ref) - 2) / C.BINS)
    m = min(len(sig), len(ref))
    return blocks, phi(int((sig[:m] & ref[:m]).sum()), int(ref.sum()), int(sig.sum()), len(ref))


def matched(needles: np.ndarray, hay: np.ndarray, tolerance: float = C.COVERAGE_TOLERANCE) -> int:
    hay = np.sort(hay)
    left = np.searchsorted(hay, needles - tolerance, "left")
    near = np.minimum(left, len(hay) - 1)
    return int((np.abs(hay[near] - needles) <= tolerance).sum()) if len(hay) else 0


def coverage(rs, s, e, scale=1.0, offset=0.0, total=0.0) -> tuple[float, float, float]:
    """(share of reference starts covered, share of probe starts matched, share of time on screen)."""
    if not len(rs) or not len(s):
        return 0.0, 0.0, 0.0
    ps, pe = scale * s + offset, scale * e + offset
    return matched(rs, ps) / len(rs), matched(ps, rs) / len(ps), (min(float(np.maximum(0, pe - ps).sum()) / total, 1.0) if total > 0 else 0.0)


def block_of(n: int, blocks: list[tuple[int, int, float]]) -> np.ndarray:
    """Block of each cue; the last block also takes what lies beyond it."""
    last = np.array([b[1] for b in blocks])
    return np.minimum(np.searchsorted(last, np.arange(n), "left"), len(blocks) - 1)


def align(rs, re, s, e, total: float = 0.0, different_cut: bool = False, karaoke: bool = False, settings=C.DEFAULTS) -> dict:
    """Verdict on a probe track against a reference track with cues; see operators.align for the fields."""
    out = {"verdict": "Declined", "scale": 1.0, "shift": 0.0, "correlation": 0.0, "ratio": 0.0, "coverage": None, "on_screen": None, "matched_on": None, "blocks": [], "reason": ""}
    rs, re = track(rs, re)
    s, e = track(s, e)
    if len(s) < C.MIN_CUES_TO_ALIGN:
        return out | {"reason": f"only {len(s)} usable cues"}
    ref = presence(rs, re, total)
    duration = len(ref) / C.BINS
    scales = C.SCALES if settings.framerate else (1.0,)
    tried = []
    for name, sig, least in (("overlap", ref, settings.min_correlation), ("onsets", onsets(rs, re, duration), settings.min_onset_correlation)):
        fits = search(sig, s, e, scales, name == "onsets", settings)
        if fits:
            f = fits[0]
            passes = f.correlation >= least and f.ratio >= settings.min_ratio
            tried.append((passes, min(f.correlation / least, f.ratio / settings.min_ratio), name, sig, least, f))
    if not tried:
        return out | {"reason": "the search gave no result"}
    _, _, name, sig, least, best = max(tried, key=lambda t: t[:2])
    if settings.framerate:
        best = refine(sig, s, e, best, name == "onsets", settings) or best
    covered, _, on_screen = coverage(rs, s, e, best.scale, best.offset, duration)
    out |= {"scale": best.scale, "shift": best.offset, "correlation": best.correlation, "ratio": best.ratio, "coverage": covered, "on_screen": on_screen, "matched_on": name}
    good = best.correlation >= least and best.ratio >= settings.min_ratio
    if settings.allow_piecewise and (not good or different_cut):
        blocks, corr = split(ref, s, e, best.offset)
        if len(blocks) > 1:
            shift = np.array([b[2] for b in blocks])[block_of(len(s), blocks)]
            c2, _, o2 = coverage(rs, s + shift, e + shift, total=duration)
            credible = (
                len(blocks) <= settings.max_blocks
                and all(y - x + 1 >= settings.min_block_cues for x, y, _ in blocks)
                and corr >= least
                and corr > best.correlation + settings.split_gain
                and c2 >= settings.min_piecewise_coverage
                and c2 > covered + settings.min_coverage_gain
            )
            if credible:
                return out | {"verdict": "PiecewiseCut", "blocks": blocks, "correlation": corr, "coverage": c2, "on_screen": o2, "reason": f"{len(blocks)} sections"}
    if not good:
        return out | {"reason": f"correlation {best.correlation:.2f}, uniqueness {best.ratio:.2f}"}
    if abs(best.scale - 1) > 1e-9:
        if abs(best.scale - 1) > settings.max_scale_deviation:
            return out | {"reason": f"scale {best.scale:.4f} is too far from 1"}
        if karaoke and settings.decline_karaoke:
            return out | {"reason": "karaoke timing would need scaling"}
        return out | {"verdict": "FramerateDrift", "reason": f"scale {best.scale:.6f}, offset {best.offset:+.3f}s"}
    if abs(best.offset) > settings.max_offset:
        return out | {"reason": f"a shift of {best.offset:+.1f}s is beyond the limit"}
    if abs(best.offset) < settings.min_correction:
        return out | {"verdict": "Exact", "scale": 1.0, "shift": 0.0, "reason": f"already in sync ({best.offset:+.3f}s)"}
    return out | {"verdict": "ConstantOffset", "reason": f"constant offset of {best.offset:+.3f}s"}
