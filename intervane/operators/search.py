"""All that is sought in a pair's cues: lags under every ratio and representation, drift, coverage, and the piecewise program.

Every step but the first reads what the one before it found for the same pair, and ratios and representations multiply the cues by
fourteen. So cues are dealt out by key once, sorted partitions are walked, and the pairs of some 100,000 cues go through each step
together in numpy; a task holds these, or one pair's cues, however many they are. Bins, overlaps and ratings are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervane import config as C
from intervane.operators import correlate as X
from intervane.operators import piecewise as PW

FLAGS = ("different_cut", "karaoke")
#: What is found of each pair. best: of the better representation; split: of a piecewise fit that may be credible.
FOUND = f"n_cues long, different_cut boolean, karaoke boolean, rep_ix int, min_correlation double, scale double, shift double, correlation double, peak_ratio double, refined boolean, reference_covered double, on_screen double, good boolean, found {PW.BLOCKS}, split_correlation double, split_coverage double, split_screen double"
#: Tracks whose programs go on side by side, and the largest sum that 32 bits are used for.
_SIDE, _SMALL = 8, 1 << 29
#: Bins of a track up to which its ratings are read off the number of bins covered before each; beyond, they are summed from slopes.
_DENSE = 1 << 20
_EDGES, _WEIGHTS = np.array([1, -1]), np.array([5, -5, 1, -1])


class Cues(NamedTuple):
    """Cues of tracks 0, 1, ..., sorted by track, start and place in the source."""

    of: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    tie: np.ndarray

    def take(self, rows: np.ndarray) -> Cues:
        return Cues(*(c[rows] for c in self))

    def moved(self, scale, shift) -> Cues:
        return self._replace(start=scale * self.start + shift, stop=scale * self.stop + shift)

    def real(self) -> Cues:
        return self.take(self.stop > self.start)


class Signal(NamedTuple):
    """Disjoint intervals (s, e) of tracks in order, and the bins of each track (-1: it has no cues)."""

    of: np.ndarray
    s: np.ndarray
    e: np.ndarray
    bins: np.ndarray

    def energy(self) -> np.ndarray:
        return np.bincount(self.of, self.e - self.s, len(self.bins)).astype(np.int64)

    def both(self, other: Signal) -> Signal:
        return Signal(np.concatenate([self.of, other.of + len(self.bins)]), *(np.concatenate([a, b]) for a, b in zip(self[1:], other[1:])))


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.rint(x).astype(np.int64)


def lengths(c: Cues, n: int) -> np.ndarray:
    """Bins of each of n tracks as intervals.lengths() has them, -1 where there are no cues. c: real cues."""
    out = np.full(n, -1, np.int64)
    if len(c.of):
        first = np.nonzero(np.diff(c.of, prepend=-1))[0]
        top = np.maximum.reduceat(c.start, first)
        at = np.nonzero(c.start == np.repeat(top, np.diff(np.append(first, len(c.of)))))[0]
        at = at[np.lexsort((c.tie[at], c.of[at]))]  # times that rounding made equal may stand in another order
        last = at[np.append(np.diff(c.of[at]) > 0, True)]
        out[c.of[last]] = np.ceil(c.stop[last] * C.BINS).astype(np.int64) + 2
    return out


def signal(c: Cues, onset: np.ndarray | bool, bins: np.ndarray) -> Signal:
    """Merged intervals of real cues, or of a pulse at each start where onset holds, cut to the bins of their track."""
    s = _rounded(c.start * C.BINS)
    e = np.maximum(_rounded(np.minimum(c.stop, c.start + C.MAX_CUE) * C.BINS), s + 1)
    e = np.where(onset, s + max(1, round(C.PULSE * C.BINS)), e)
    if not len(s):
        return Signal(c.of, s, e, bins)
    low = int(s.min())
    far = c.of * (int(e.max()) - low + 1) - low  # keeps tracks apart
    reach = np.maximum.accumulate(e + far)
    first = np.nonzero(np.append(True, (s + far)[1:] > reach[:-1]))[0]
    of, s, e = c.of[first], s[first], (reach - far)[np.append(first[1:], len(s)) - 1]
    s, e = np.maximum(s, 0), np.minimum(e, bins[of])
    keep = e > s
    return Signal(of[keep], s[keep], e[keep], bins)


def phi(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """correlate.phi() of arrays."""
    a, b, n = (x.astype(float) for x in (a, b, n))
    with np.errstate(all="ignore"):
        spread = a * (1 - a / n) * b * (1 - b / n)
        ok = (n > 0) & (a > 0) & (b > 0) & (a < n) & (b < n) & (spread > 0)
        return np.where(ok, (overlap - a * b / n) / np.sqrt(spread), 0.0)


class Fits(NamedTuple):
    there: np.ndarray
    lag: np.ndarray
    correlation: np.ndarray
    ratio: np.ndarray


def correlate(ref: Signal, probe: Signal, of_ref: np.ndarray, settings: C.Settings) -> Fits:
    """correlate.correlate() of each probe with reference of_ref; there: both have intervals."""
    a, b = ref.energy()[of_ref], probe.energy()
    lag, top, second, _ = X.searched(ref.of, ref.s, ref.e, probe.of, probe.s, probe.e, of_ref, round(settings.max_search * C.BINS), round(settings.peak_guard * C.BINS))
    corr = np.where(top > 0, phi(top, a, b, np.maximum(ref.bins[of_ref], probe.bins)), 0.0)
    ratio = np.where(top <= 0, 0.0, np.where(second > 0, top / np.maximum(second, 1), C.NO_SECOND_PEAK))
    return Fits((a > 0) & (b > 0), lag, corr, ratio)


class Best(NamedTuple):
    """Arrays of the fit of each pair; rep is -1 where there is none."""

    rep: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    correlation: np.ndarray
    ratio: np.ndarray
    refined: np.ndarray


def _over_ratios(ref: Signal, of_ref: np.ndarray, probe: Cues, onset: bool, scales: tuple, n: int, settings: C.Settings) -> tuple[np.ndarray, ...]:
    """(there, scale, lag, correlation, ratio): as correlate.best_fit()."""
    top, plain = [np.zeros(n, bool), *(np.zeros(n) for _ in range(4))], None
    for scale in scales:
        p = Cues(probe.of, probe.start * scale, probe.stop * scale, probe.tie)
        f = correlate(ref, signal(p.real(), onset, lengths(p.real(), n)), of_ref, settings)
        row = [f.there, np.full(n, float(scale)), f.lag, f.correlation, f.ratio]
        plain = row if plain is None else plain
        better = f.there & (~top[0] | (f.correlation > top[3]))
        top = [np.where(better, new, old) for new, old in zip(row, top)]
    keep = plain[0] & (top[3] - plain[3] < settings.scale_margin)
    return tuple(np.where(keep, a, b) for a, b in zip(plain, top))


def least(settings: C.Settings) -> np.ndarray:
    return np.array([settings.min_correlation, settings.min_onset_correlation])


def hypotheses(ref: Signal, probe: Cues, n: int, settings: C.Settings) -> Best:
    """The better representation of each pair at its best ratio, as correlate.choose_hypothesis(). ref: both representations, one after the other."""
    scales = C.SCALES if settings.framerate else (1.0,)
    fits = [_over_ratios(ref, np.arange(n) + rep * n, probe, rep == 1, scales, n, settings) for rep in (0, 1)]
    (there, *overlap), (there1, *onsets) = fits
    mine = []
    for (_, _, corr, ratio), low in zip((overlap, onsets), least(settings)):
        mine.append(((corr >= low) & (ratio >= settings.min_ratio), np.minimum(corr / low, ratio / settings.min_ratio)))
    (passes, margin), (passes1, margin1) = mine
    second = there1 & (~there | (passes1 & ~passes) | ((passes1 == passes) & (margin1 > margin)))
    scale, lag, corr, ratio = (np.where(second, b, a) for a, b in zip(overlap, onsets))
    return Best(np.where(second, 1, np.where(there, 0, -1)), scale, lag / float(C.BINS), corr, ratio, np.zeros(n, bool))


def refine(ref: Signal, probe: Cues, best: Best, n: int, settings: C.Settings) -> Best:
    """best, refined by residual drift: at most four passes over the pairs that still improve.

    The front and the back of each probe are sought within the reference; what their lags say of scale and shift is tried on the
    whole probe and kept if it correlates better, else the pair is done.
    """
    cues = np.bincount(probe.of, minlength=n)
    part = np.floor(cues * C.DRIFT_FRACTION).astype(np.int64)
    place = np.arange(len(probe.of)) - np.repeat(np.cumsum(cues) - cues, cues)
    scale, shift, corr, ratio, refined = (c.copy() for c in best[1:])
    live = np.nonzero((best.rep >= 0) & (part >= C.DRIFT_MIN_CUES))[0]
    for _ in range(C.DRIFT_PASSES):
        if not len(live):
            break
        at = np.full(n, -1)
        at[live] = np.arange(len(live))
        own = at[probe.of] >= 0
        now, back = probe.take(own), place[own] >= (cues - part)[probe.of[own]]
        now = now.moved(scale[now.of], shift[now.of])
        ends = back | (place[own] < part[now.of])
        now, of = now.take(ends), 2 * at[now.of[ends]] + back[ends]
        of_ref = np.arange(n)[live] + np.maximum(best.rep[live], 0) * n
        real, onset = now._replace(of=of).real(), best.rep[now.of[now.stop > now.start]] == 1
        f = correlate(ref, signal(real, onset, lengths(real, 2 * len(live))), np.repeat(of_ref, 2), settings)
        with np.errstate(all="ignore"):
            mean = np.bincount(of, now.start, 2 * len(live)) / np.bincount(of, minlength=2 * len(live))
            r = np.where(f.there, f.lag / float(C.BINS), np.nan)
            bend, span = r[1::2] - r[::2], mean[1::2] - mean[::2]
            worth = (span >= C.DRIFT_MIN_SPAN) & (np.abs(bend) >= C.DRIFT_DISAGREEMENT) & (np.abs(bend / span) <= C.DRIFT_MAX_DEVIATION)
            extra = 1 + bend / span
            new_scale, new_shift = scale[live] * extra, shift[live] * extra + r[::2] - (extra - 1) * mean[::2]
        live, new_scale, new_shift, of_ref = live[worth], new_scale[worth], new_shift[worth], of_ref[worth]
        at = np.full(n, -1)
        at[live] = np.arange(len(live))
        again = probe.take(at[probe.of] >= 0)
        onset, of = best.rep[again.of] == 1, at[again.of]
        again = again._replace(of=of).moved(new_scale[of], new_shift[of])
        onset, again = onset[again.stop > again.start], again.real()
        f = correlate(ref, signal(again, onset, lengths(again, len(live))), of_ref, settings)
        better = f.there & (f.correlation > corr[live])
        live = live[better]
        scale[live], shift[live], corr[live], ratio[live], refined[live] = new_scale[better], new_shift[better], f.correlation[better], f.ratio[better], True
    return Best(best.rep, scale, shift, corr, ratio, refined)


def near(needles: Cues, hay: Cues, n: int) -> np.ndarray:
    """Starts of each track's needles, equal cues once, with a start of its hay within the tolerance; see coverage.near()."""
    of, t = np.concatenate([needles.of, hay.of]), np.concatenate([needles.start, hay.start])
    order = np.lexsort((t, of))
    is_hay = order >= len(needles.of)
    of, t, spot = of[order], t[order], np.arange(len(order))
    hit = np.zeros(len(order), bool)
    for other in (np.maximum.accumulate(np.where(is_hay, spot, -1)), np.minimum.accumulate(np.where(is_hay, spot, len(spot))[::-1])[::-1]):
        found = (other >= 0) & (other < len(spot))
        k = np.where(found, other, 0)
        hit |= found & (of[k] == of) & (np.abs(t - t[k]) <= C.COVERAGE_TOLERANCE)
    mine = order[hit & ~is_hay]
    c = needles.take(mine[np.lexsort((needles.tie[mine], needles.start[mine], needles.of[mine]))])
    new = np.append(True, (np.diff(c.of) != 0) | (np.diff(c.start) != 0) | (c.tie[1:] != c.tie[:-1]))[: len(c.of)]
    return np.bincount(c.of[new], minlength=n)


def coverage(ref: Cues, probe: Cues, total: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(reference_covered, on_screen) as coverage.measure(), NaN where either side has no cues. probe: real cues, corrected already."""
    a, b = np.bincount(ref.of, minlength=n), np.bincount(probe.of, minlength=n)
    shown = np.bincount(probe.of, probe.stop - probe.start, n)
    with np.errstate(all="ignore"):
        covered = np.where((a > 0) & (b > 0), near(ref, probe, n) / a, np.nan)
        screen = np.where((a > 0) & (b > 0), np.where(total > 0, np.minimum(shown / total, 1.0), 0.0), np.nan)
    return covered, screen


def _slopes(ref: Signal, a: np.ndarray, b: np.ndarray, g: np.ndarray, first: np.ndarray, lo: np.ndarray, hi: np.ndarray, side: np.ndarray, wide: int) -> tuple[np.ndarray, ...]:
    """(spot, weight, ends, before): where the slope of each cue's rating changes (side * wide + offset) and by how much, up to which of these a cue's go, and less its first rating; see piecewise.rating()."""
    many = hi - lo
    cue = np.repeat(np.arange(len(a)), many)
    piece = np.arange(len(cue)) + np.repeat(lo - np.cumsum(many) + many, many)
    marks = np.stack([b, a, a - g, b + g], 1) + first[:, None]
    at = np.stack([ref.s[piece], ref.e[piece]], 1)[:, :, None] - marks[cue][:, None, :]
    w = np.broadcast_to(_EDGES[:, None] * _WEIGHTS, at.shape)
    before = np.bincount(cue, (w * np.minimum(at, 0)).sum(axis=(1, 2)), len(a)).astype(np.int64)
    to = np.maximum(at, 0) + 1  # a slope holds from the next offset on
    inside = to < wide
    spot = (side[cue][:, None, None] * wide + to)[inside]
    return spot, w[inside], np.cumsum(np.bincount(cue, inside.sum(axis=(1, 2)), len(a)).astype(np.int64)), before


def _rated(ref: Signal, chunk: np.ndarray, a: np.ndarray, b: np.ndarray, g: np.ndarray, first: np.ndarray, lo: np.ndarray, hi: np.ndarray, side: np.ndarray, last: np.ndarray, upto: np.ndarray, rate: np.ndarray) -> Iterator[None]:
    """Writes the ratings of each step's cues, one of a track, over the first rows of rate. last: where each step's cues end; upto: intervals met by then."""
    m, wide = rate.shape
    low, high = np.full(m, 1 << 62), np.full(m, -(1 << 62))
    np.minimum.at(low, side, a - g + first)
    np.maximum.at(high, side, b + g + first + wide)
    if (high - low).max() <= _DENSE:
        before = []  # bins covered before each bin of a track, from low on
        ramp = np.arange(int((high - low).max()) + 2, dtype=np.int32)
        for t, x, y in zip(chunk.tolist(), low.tolist(), high.tolist()):
            covered, n, at = np.empty(y - x + 1, np.int32), 0, 0
            mine = slice(*np.searchsorted(ref.of, (t, t + 1)).tolist())
            for s, e in zip(np.clip(ref.s[mine] - x, 0, y - x).tolist(), np.clip(ref.e[mine] - x, 0, y - x).tolist()):
                covered[at : s + 1] = n
                covered[s + 1 : e + 1] = ramp[n + 1 : n + 1 + e - s]
                n, at = n + e - s, e + 1
            covered[at:] = n
            before.append(covered)
        places = [(c + first - low[side]).tolist() for c in (a, b, a - g, b + g)]
        x = 0
        for y in last.tolist():
            for p, r, at, to, ahead, after in zip(before, rate, *(c[x:y] for c in places)):
                np.subtract(p[to : to + wide], p[at : at + wide], out=r)
                r *= 5
                r += p[ahead : ahead + wide]
                r -= p[after : after + wide]
            x = y
            yield
        return
    x = j = 0
    while j < len(last):  # as many steps at a time as meet X._MET intervals
        to = max(j + 1, int(np.searchsorted(upto, (upto[j - 1] if j else 0) + X._MET, "right")))
        cues_of = slice(x, int(last[to - 1]))
        spot, weight, ends, less = _slopes(ref, *(c[cues_of] for c in (a, b, g, first, lo, hi)), side[cues_of], wide)
        weight, begun, done = weight.astype(rate.dtype), x, 0
        for y in last[j:to].tolist():
            r = rate[: y - x]
            r.fill(0)
            end = int(ends[y - 1 - begun])
            np.add.at(rate.reshape(-1), spot[done:end], weight[done:end])
            np.cumsum(r, axis=1, out=r)
            r[:, 0] = -less[x - begun : y - begun]
            np.cumsum(r, axis=1, out=r)
            x, done = y, end
            yield
        j = to


def program(ref: Signal, probe: Cues, centre: np.ndarray, n: int) -> list[list[tuple[int, int, float]]]:
    """Blocks (first cue, last cue, offset) of each track's best path over offsets, as piecewise.split(); none without reference intervals.

    _SIDE tracks of about equal length go cue by cue side by side, two numbers an offset for each.
    """
    wide, price = 2 * round(C.SPLIT_RADIUS * C.BINS) + 1, round(4 * C.SPLIT_PENALTY * C.BINS)
    cues, heard = np.bincount(probe.of, minlength=n), np.bincount(ref.of, minlength=n)
    begin = np.cumsum(cues) - cues
    a = _rounded(probe.start * C.BINS)
    b = np.maximum(a + 1, _rounded(probe.stop * C.BINS))
    g = np.minimum(b - a, C.SPLIT_GUARD)
    first = (_rounded(centre * C.BINS) - round(C.SPLIT_RADIUS * C.BINS))[probe.of]
    out: list = [[] for _ in range(n)]
    if not len(ref.of) or not len(a):
        return out
    low = min(int(ref.s.min()), int((a - g + first).min()))
    apart = max(int(ref.e.max()), int((b + g + first).max()) + wide) - low + 1
    lo = np.searchsorted(ref.e + ref.of * apart - low, a - g + first + probe.of * apart - low, "right")
    hi = np.searchsorted(ref.s + ref.of * apart - low, b + g + first + wide - 1 + probe.of * apart - low, "left")
    order = np.nonzero((cues > 0) & (heard > 0))[0]
    order = order[np.argsort(-cues[order], kind="stable")]
    for chunk in (order[k : k + _SIDE] for k in range(0, len(order), _SIDE)):
        m = len(chunk)
        steps = cues[chunk]
        # Cues in the order of the steps: the first of each track, the second of each, ...
        row = np.concatenate([begin[t] + np.arange(cues[t]) for t in chunk])
        side, step = np.repeat(np.arange(m), steps), np.concatenate([np.arange(k) for k in steps])
        by = np.lexsort((side, step))
        row, side, step = row[by], side[by], step[by]
        last = np.searchsorted(step, np.arange(int(steps.max())), "right")
        upto = np.cumsum(hi[row] - lo[row])[last - 1]
        small = int(6 * np.bincount(side, (b - a)[row]).max()) + 6 * price + 100 * int((hi[row] - lo[row]).max(initial=0)) < _SMALL
        kind = np.int32 if small else np.int64
        score, rate, since, under = np.zeros((m, wide), kind), np.zeros((m, wide), kind), np.zeros((m, wide), np.int32), np.zeros((m, wide), bool)
        best, taken, top, x = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), None, 0
        rated = _rated(ref, chunk, *(c[row] for c in (a, b, g, first, lo, hi)), side, last, upto, rate)
        for j, y in enumerate(last.tolist()):
            k = y - x
            next(rated)
            r, s, u, t = rate[:k], score[:k], under[:k], since[:k]
            if j:
                leap = (top[:k] - price).astype(kind)[:, None]
                np.less(s, leap, out=u)
                np.copyto(t, j, where=u)
                np.maximum(s, leap, out=s)
            np.add(s, r, out=s)
            where = s.argmax(axis=1)
            top = s[np.arange(k), where]
            best[x:y], taken[x:y] = where, t[np.arange(k), where]
            x = y
        for i, t in enumerate(chunk.tolist()):
            mine = side == i
            at_, since_, from_ = best[mine].tolist(), taken[mine].tolist(), int(first[begin[t]])
            c, found = len(at_) - 1, []
            while c >= 0:
                found.append((since_[c], c, (from_ + at_[c]) / float(C.BINS)))
                c = since_[c] - 1
            out[t] = found[::-1]
    return out


def _overlap(a: Signal, b: Signal, n: int) -> np.ndarray:
    """Bins that both have, of each track."""
    wide = int(max(a.e.max(initial=0), b.e.max(initial=0))) + 1
    far, of = a.of * wide, b.of * wide
    lo, hi = np.searchsorted(a.e + far, b.s + of, "right"), np.searchsorted(a.s + far, b.e + of, "left")
    many = np.maximum(hi - lo, 0)
    row = np.repeat(np.arange(len(b.of)), many)
    k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + lo[row]
    return np.bincount(b.of[row], np.minimum(a.e[k], b.e[row]) - np.maximum(a.s[k], b.s[row]), n).astype(np.int64)


def pieces(ref_cues: Cues, ref: Signal, probe: Cues, shift: np.ndarray, pairs: np.ndarray, n: int, settings: C.Settings) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """(blocks, correlation, coverage, on_screen) of those pairs whose path has as many blocks, and as long ones, as a credible fit may have."""
    open_ = np.zeros(n, bool)
    open_[pairs] = True
    own = probe.take(open_[probe.of])
    mine = open_[ref.of]
    heard = Signal(ref.of[mine], ref.s[mine], ref.e[mine], ref.bins)
    paths = program(heard, own, shift, n)
    fit = lambda p: 1 < len(p) <= settings.max_blocks and all(y - x + 1 >= settings.min_block_cues for x, y, _ in p)
    found = [p if fit(p) else None for p in paths]
    some = np.array([p is not None for p in found], bool)
    own = own.take(some[own.of])
    if not len(own.of):
        return found, *(np.full(n, np.nan) for _ in range(3))
    late = np.concatenate([np.repeat([o for _, _, o in p], [y - x + 1 for x, y, _ in p]) for p in found if p is not None])
    again = own._replace(start=own.start + late, stop=own.stop + late).real()
    # Blocks may turn the order of cues.
    again = again.take(np.lexsort((again.tie, again.start, again.of)))
    keep = some[heard.of]
    heard = Signal(heard.of[keep], heard.s[keep], heard.e[keep], ref.bins)
    shifted = signal(again, False, np.where(some, (np.ceil((ref.bins - 2) / float(C.BINS) * C.BINS) + 2).astype(np.int64), -1))
    corr = phi(_overlap(heard, shifted, n), heard.energy(), shifted.energy(), ref.bins)
    covered, screen = coverage(ref_cues.take(some[ref_cues.of]), again, ref.bins / float(C.BINS), n)
    return found, corr, covered, screen


def _column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _cues(table: pa.Table, of: np.ndarray, rows: np.ndarray) -> Cues:
    start, stop = (_column(table, c).to_numpy(zero_copy_only=False).astype(float)[rows] for c in ("start", "stop"))
    tie = pc.fill_null(_column(table, "src_ix"), -(1 << 63)).to_numpy(zero_copy_only=False)[rows]
    if not (np.isfinite(start).all() and np.isfinite(stop).all()):
        raise ValueError("times of cues must be finite")
    return Cues(of[rows], start, stop, tie)


def _worked(table: pa.Table, keys: list[str], settings: C.Settings, drift_only: bool) -> Iterator[pa.RecordBatch]:
    """Rows of whole keys, sorted, to one row a pair."""
    turn = X._turns(table, keys)
    of = np.cumsum(turn) - 1
    n, rows = int(of[-1]) + 1, np.nonzero(turn)[0]
    side = _column(table, "_side").to_numpy()
    real = _column(table, "_real").to_numpy(zero_copy_only=False)
    far = np.abs(np.concatenate([_column(table, c).to_numpy(zero_copy_only=False).astype(float)[real] for c in ("start", "stop")])).max(initial=0)
    if n > 1 and 4.0 * n * (far + settings.max_search + 2 * C.SPLIT_RADIUS) * C.BINS > 1 << 60:  # tracks are kept apart by numbers of their own
        half = int(rows[n // 2])
        yield from _worked(table.slice(0, half), keys, settings, drift_only)
        yield from _worked(table.slice(half), keys, settings, drift_only)
        return
    sought = np.bincount(of[side == 1], minlength=n) > 0
    n_cues = np.bincount(of[(side == 1) & real], minlength=n)
    flags = [np.bincount(of, (side == 1) & pc.fill_null(_column(table, c), False).to_numpy(zero_copy_only=False), n) > 0 for c in FLAGS]
    enough = n_cues >= (1 if drift_only else C.MIN_CUES_TO_ALIGN)
    heard, probe = _cues(table, of, (side == 0) & real), _cues(table, of, (side == 1) & real & enough[of])

    bins = lengths(heard, n)
    over = signal(heard, False, bins)
    if drift_only:
        ref = over
        f = correlate(ref, signal(probe, False, lengths(probe, n)), np.arange(n), settings)
        best = Best(np.where(f.there, 0, -1), np.ones(n), f.lag / float(C.BINS), f.correlation, f.ratio, np.zeros(n, bool))
    else:
        later = np.where(bins >= 0, (np.ceil(bins / float(C.BINS) * C.BINS) + 2).astype(np.int64), -1)
        ref = over.both(signal(heard, True, later))
        best = hypotheses(ref, probe, n, settings)
    if drift_only or settings.framerate:
        best = refine(ref, probe, best, n, settings)
    there = best.rep >= 0
    covered, screen = np.full(n, np.nan), np.full(n, np.nan)
    blocks, split = [None] * n, [np.full(n, np.nan) for _ in range(3)]
    low = least(settings)[np.maximum(best.rep, 0)]
    good = there & (best.correlation >= low) & (best.ratio >= settings.min_ratio)
    if not drift_only:
        own = probe.take(there[probe.of])
        covered, screen = coverage(heard, own.moved(best.scale[own.of], best.shift[own.of]).real(), bins / float(C.BINS), n)
        undecided = there & (~good | flags[0])
        if settings.allow_piecewise and undecided.any():
            blocks, *split = pieces(heard, over, probe, best.shift, np.nonzero(undecided)[0], n, settings)

    told = np.nonzero(there if drift_only else sought)[0]
    value = lambda x, ok, kind=None: pa.array(x[told], kind, mask=~(ok[told] & ~np.isnan(x[told].astype(float))))
    every = np.ones(n, bool)
    has = np.array([p is not None for p in blocks], bool)
    kind = pa.list_(pa.struct([("first_cue", pa.int32()), ("last_cue", pa.int32()), ("offset", pa.float64())]))
    listed = [blocks[k] if blocks[k] is None else [{"first_cue": x, "last_cue": y, "offset": o} for x, y, o in blocks[k]] for k in told]
    columns = [
        *(_column(table, k).take(pa.array(rows[told])) for k in keys), value(n_cues, every, pa.int64()), *(value(f, every, pa.bool_()) for f in flags),
        value(best.rep, there, pa.int32()), *(value(c, there, pa.float64()) for c in (low, best.scale, best.shift, best.correlation, best.ratio)), value(best.refined, there, pa.bool_()),
        value(covered, there), value(screen, there), value(good, every, pa.bool_()), pa.array(listed, kind), *(value(c, has) for c in split),
    ]
    names = [*keys, *(f.split()[0] for f in FOUND.split(", "))]
    yield from pa.Table.from_arrays(columns, names=names).to_batches()


def found(ref_cues: DataFrame, probe_cues: DataFrame, keys: list[str], settings: C.Settings = C.DEFAULTS, drift_only: bool = False) -> DataFrame:
    """(keys, FOUND), a row for each key of probe_cues. Cues: (keys, src_ix, start, stop); the probe may also have FLAGS.

    drift_only: the best unscaled overlap, refined, of the keys that have one, however few their cues are.
    """
    real = F.coalesce(F.col("stop") > F.col("start"), F.lit(False)).alias("_real")
    cue = [*keys, F.col("src_ix").cast("long").alias("src_ix"), F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop"), real]
    flags = [F.col(c) if c in probe_cues.columns else F.lit(False).alias(c) for c in FLAGS]
    a = ref_cues.dropna(subset=keys).where("stop > start").select(*cue, *[F.lit(False).alias(c) for c in FLAGS], F.lit(0).cast("byte").alias("_side"))
    b = probe_cues.select(*cue, *flags, F.lit(1).cast("byte").alias("_side"))
    # A number of partitions, as their bytes, by which they would be put together, say little of the work.
    n = int(probe_cues.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = a.unionByName(b).repartition(n, F.xxhash64(*keys)).sortWithinPartitions(*keys, "_side", "start", "src_ix", "stop")
    kinds = dict(probe_cues.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in X.whole_keys(batches, keys):
            yield from _worked(table, keys, settings, drift_only)

    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", {FOUND}")
