"""Cross-correlation of interval signals over all lags, as an exchange of intervals and sums over each pair's lags.

The overlap of two signals as a function of the lag is piecewise linear: each pair of intervals adds four impulses to its
second difference. Impulses are many times the intervals, so they are never rows: both tracks of a pair are dealt out by key, sorted
partitions are walked, and the impulses of a few pairs at a time are summed where they arise. All numbers are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervane import config as C
from intervane.operators import intervals as I

_PIECE = 1000
#: Rows walked at a time, pairs whose lags are summed together, and pairs of intervals met at a time.
_ROWS, _BLOCK, _MET = 100_000, 32, 500_000
#: Lags for each impulse beyond which impulses are sorted.
_FEW = 2
_REF, _REF_BINS, _PROBE, _PROBE_BINS = range(4)


def _pieces(merged: DataFrame) -> DataFrame:
    """Intervals cut to at most _PIECE bins, so that a bound on the distance of starts bounds the distance of the whole."""
    at = F.explode(F.sequence(F.col("s"), F.col("e") - 1, F.lit(_PIECE)))
    return merged.withColumn("_p", at).withColumn("e", F.least(F.col("e"), F.col("_p") + _PIECE)).withColumn("s", F.col("_p")).drop("_p")


def summed(g: np.ndarray, b0: np.ndarray, b1: np.ndarray, lo: np.ndarray, hi: np.ndarray, a0: np.ndarray, a1: np.ndarray, n: int, limit: int) -> np.ndarray:
    """Overlap of n pairs at each lag from -limit to limit. Interval (b0, b1) of pair g meets the reference intervals lo to hi."""
    wide, many = 2 * limit + 2, hi - lo
    bends, carry = np.zeros(n * wide, np.int64), np.zeros(n)
    ends = np.cumsum(many)
    at = 0
    while at < len(g):  # one interval meets no more than lie within the limit
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _MET, "right")))
        m = many[at:to]
        row = np.repeat(np.arange(at, to), m)
        a = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m) + lo[row]
        x0, x1, y0, y1, of = a0[a], a1[a], b0[row], b1[row], g[row]
        for sign, lags in ((1, (x0 - y1, x1 - y0)), (-1, (x0 - y0, x1 - y1))):
            for lag in lags:  # what bends below -limit is folded into it, what bends beyond the limit goes to a place that is dropped
                bends += sign * np.bincount(of * wide + np.clip(lag, -limit, limit + 1) + limit, minlength=n * wide)
                carry += sign * np.bincount(of, np.maximum(-limit - lag, 0), n)
        at = to
    slope = np.cumsum(bends.reshape(n, wide)[:, :-1], axis=1)
    rise = np.concatenate([np.rint(carry).astype(np.int64)[:, None], slope[:, :-1]], axis=1)
    return np.cumsum(rise, axis=1)


def _turns(table: pa.Table, names: list[str]) -> np.ndarray:
    """Whether each row differs from the one before it in any of the columns."""
    out = np.zeros(len(table), bool)
    out[:1] = True
    for k in names:
        c = table.column(k).combine_chunks()
        out[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
        if c.null_count:
            out[1:] |= np.diff(c.is_null().to_numpy(zero_copy_only=False))
    return out


def _dense(g: np.ndarray, b0: np.ndarray, b1: np.ndarray, lo: np.ndarray, hi: np.ndarray, a0: np.ndarray, a1: np.ndarray, n: int, limit: int, guard: int) -> tuple[np.ndarray, ...]:
    """peaks() from the overlap at every lag."""
    ov = summed(g, b0, b1, lo, hi, a0, a1, n, limit)
    best = ov.argmax(axis=1)
    top, least = ov[np.arange(n), best], ov.min(axis=1)
    for i, b in enumerate(best):
        ov[i, max(0, b - guard) : b + guard + 1] = 0
    return best - limit, top, ov.max(axis=1), least


def _sparse(g: np.ndarray, b0: np.ndarray, b1: np.ndarray, lo: np.ndarray, hi: np.ndarray, a0: np.ndarray, a1: np.ndarray, n: int, limit: int, guard: int) -> tuple[np.ndarray, ...]:
    """peaks() from the overlap at the lags where it bends, and at the ends of what lies away from the best lag: between these it is straight."""
    many = hi - lo
    row = np.repeat(np.arange(len(g)), many)
    a = np.arange(len(row)) + np.repeat(lo - np.cumsum(many) + many, many)
    x0, x1, y0, y1, of = a0[a] + limit, a1[a] + limit, b0[row], b1[row], g[row]
    bits, ends, carry, each = (2 * limit + 1).bit_length(), 2 * limit, np.zeros(n), np.arange(n)
    kind = np.int32 if n << bits + 2 < 1 << 31 else np.int64
    # One number says the pair, the place and how the slope changes there (by one less than the last two bits).
    size = len(row)
    marks, shifted = np.empty(4 * size + 2 * n, kind), (of << bits + 2).astype(kind)
    for k, (sign, lag) in enumerate(((1, x0 - y1), (1, x1 - y0), (-1, x0 - y0), (-1, x1 - y1))):
        under = np.nonzero(lag < 0)[0]
        if len(under):
            carry += sign * np.bincount(of[under], -lag[under], n)
        spot = marks[k * size : (k + 1) * size]
        np.clip(lag, 0, ends, out=spot, casting="unsafe")
        spot <<= 2
        spot += shifted
        spot += sign + 1
    marks[4 * size : 4 * size + n], marks[4 * size + n :] = each << bits + 2 | 1, (each << bits | ends) << 2 | 1
    marks.sort()
    at = marks >> 2
    place = at & ((1 << bits) - 1)
    first = np.searchsorted(at, (each << bits).astype(kind))
    size = np.diff(np.append(first, len(at)))
    slope = np.cumsum((marks & 3) - 1, dtype=np.int64)
    slope -= np.repeat(np.concatenate([[0], slope[first[1:] - 1]]), size)
    ov = np.zeros(len(at), np.int64)
    np.cumsum(slope[:-1] * np.diff(place), out=ov[1:])
    ov -= np.repeat(ov[first] - np.rint(carry).astype(np.int64), size)
    top, least = np.maximum.reduceat(ov, first), np.minimum.reduceat(ov, first)
    tops = np.nonzero(ov == np.repeat(top, size))[0]
    best = place[tops[np.searchsorted(at[tops] >> bits, each.astype(kind))]].astype(np.int64)
    second = np.maximum.reduceat(np.where(np.abs(place - np.repeat(best, size)) > guard, ov, 0), first)
    for edge in (best - guard - 1, best + guard + 1):
        k = np.searchsorted(at, (each << bits | np.clip(edge, 0, ends)).astype(kind), "right") - 1
        second = np.maximum(second, np.where((edge >= 0) & (edge <= ends), ov[k] + slope[k] * (edge - place[k]), 0))
    return best - limit, top, second, least


def peaks(g: np.ndarray, b0: np.ndarray, b1: np.ndarray, lo: np.ndarray, hi: np.ndarray, a0: np.ndarray, a1: np.ndarray, n: int, limit: int, guard: int) -> tuple[np.ndarray, ...]:
    """(best lag, its overlap, the best overlap more than guard away, the least) of n pairs; arguments as of summed(). Few impulses are sorted, many counted lag by lag."""
    find = _sparse if 4 * int((hi - lo).sum()) * _FEW < n * (2 * limit + 1) else _dense
    return find(g, b0, b1, lo, hi, a0, a1, n, limit, guard)


def searched(a_ref: np.ndarray, a0: np.ndarray, a1: np.ndarray, b_pair: np.ndarray, b0: np.ndarray, b1: np.ndarray, of_ref: np.ndarray, limit: int, guard: int) -> tuple[np.ndarray, ...]:
    """(lag, overlap, second, least) of each pair; lag and second are 0 where nothing overlaps.

    Disjoint intervals in order: (a0, a1) of reference a_ref, (b0, b1) of pair b_pair, whose reference is of_ref[b_pair].
    """
    low = min(a0.min(initial=0), b0.min(initial=0))
    wide = int(max(a1.max(initial=0), b1.max(initial=0)) - low + 2 * limit + 4)
    base = of_ref[b_pair] * wide - low
    lo = np.searchsorted(a1 + a_ref * wide - low, b0 - limit + base, "left")
    hi = np.searchsorted(a0 + a_ref * wide - low, b1 + limit + base, "right")
    n_pairs = len(of_ref)
    lag, top, second, least = (np.zeros(n_pairs, np.int64) for _ in range(4))
    cuts = np.searchsorted(b_pair, np.arange(0, n_pairs + _BLOCK, _BLOCK))
    for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
        at = slice(k * _BLOCK, min(n_pairs, (k + 1) * _BLOCK))
        n = at.stop - at.start
        lag[at], top[at], second[at], least[at] = peaks(b_pair[x:y] - at.start, b0[x:y], b1[x:y], lo[x:y], hi[x:y], a0, a1, n, limit, guard)
    lag[top <= 0], second[top <= 0] = 0, 0
    return lag, top, second, least


def _fits(table: pa.Table, shared: list[str], own: list[str], limit: int, guard: int) -> pa.Table:
    """Rows of whole keys, sorted, to one row a pair; see overlaps()."""
    ref_ix = np.cumsum(_turns(table, shared)) - 1
    side, s, e = (table.column(c).to_numpy() for c in ("_side", "s", "e"))
    n_refs = int(ref_ix[-1]) + 1
    is_ref = side == _REF
    a0, a1, a_ref = s[is_ref], e[is_ref], ref_ix[is_ref]
    n_a, n_ref = np.full(n_refs, -1), np.zeros(n_refs, np.int64)
    n_a[ref_ix[side == _REF_BINS]] = s[side == _REF_BINS]
    np.add.at(n_ref, a_ref, a1 - a0)

    probes = np.nonzero(side >= _PROBE)[0]
    p = table.take(probes)
    turn = _turns(p, own) if own else np.zeros(len(probes), bool)
    turn[1:] |= ref_ix[probes][1:] != ref_ix[probes][:-1]
    turn[:1] = True
    pair, first = np.cumsum(turn) - 1, np.nonzero(turn)[0]
    n_pairs, of_ref = len(first), ref_ix[probes][first]
    n_b, n_probe = np.full(n_pairs, -1), np.zeros(n_pairs, np.int64)
    is_bins = side[probes] == _PROBE_BINS
    n_b[pair[is_bins]] = s[probes][is_bins]
    b0, b1, b_pair = s[probes][~is_bins], e[probes][~is_bins], pair[~is_bins]
    np.add.at(n_probe, b_pair, b1 - b0)

    lag, top, second, least = searched(a_ref, a0, a1, b_pair, b0, b1, of_ref, limit, guard)
    out = p.select([*shared, *own]).take(first)
    for name, c in (("lag", lag), ("overlap", top), ("second", second), ("least", least), ("energy_a", n_ref[of_ref]), ("energy_b", n_probe), ("_na", n_a[of_ref]), ("_nb", n_b)):
        out = out.append_column(name, pa.array(c, pa.int64()))
    return out.filter(pa.array((n_ref[of_ref] > 0) & (n_probe > 0) & (n_a[of_ref] >= 0) & (n_b >= 0)))


def whole_keys(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted rows as tables of _ROWS rows or more, each of whole keys."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        last = [batch.column(k)[-1] for k in keys]
        if n < _ROWS or [held[0].column(k)[0] for k in keys] == last:
            continue
        # The last key may go on in the next batch.
        table = pa.Table.from_batches(held)
        cut = int(np.nonzero(_turns(table, keys))[0][-1])
        yield table.slice(0, cut)
        held, n = table.slice(cut).to_batches(), n - cut
    if held:
        yield pa.Table.from_batches(held)


def overlaps(ref: DataFrame, probe: DataFrame, ref_bins: DataFrame, probe_bins: DataFrame, keys: list[str], limit: int, guard: int) -> DataFrame:
    """(keys, lag, overlap, second, least, energy_a, energy_b, _na, _nb): best lag (ties: the lowest), the best overlap more than guard away from it, and the least.

    Of pairs with intervals and bins on both sides. ref and ref_bins may lack some of the keys: each of their tracks then serves
    all pairs of the keys it has, and is sent and kept once. One exchange, of intervals; a task holds one track and a few pairs.
    """
    shared = [k for k in keys if k in ref.columns]
    own = [k for k in keys if k not in shared]
    n = F.col("n_bins").cast("long").alias("s")
    rows = [(ref, _REF, shared, "s", "e"), (ref_bins, _REF_BINS, shared, n, F.lit(0).alias("e")), (probe, _PROBE, keys, "s", "e"), (probe_bins, _PROBE_BINS, keys, n, F.lit(0).alias("e"))]
    both = None
    for d, side, on, s, e in rows:
        d = d.dropna(subset=on).select(*on, F.lit(side).cast("byte").alias("_side"), s, e)
        d = d.withColumns({"s": F.col("s").cast("long"), "e": F.col("e").cast("long")})
        both = d if both is None else both.unionByName(d, allowMissingColumns=True)
    kinds = dict(probe.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*shared, *own]) + "".join(f", {c} long" for c in ("lag", "overlap", "second", "least", "energy_a", "energy_b", "_na", "_nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, shared):
            yield from _fits(table, shared, own, limit, guard).to_batches()

    # By a hash of the keys: a repartition by the keys themselves is left out where all four parts are already dealt out by them, each into
    # partitions of its own number.
    return both.repartition(F.xxhash64(*shared)).sortWithinPartitions(*shared, *own, "_side", "s").mapInArrow(run, schema)


def phi(overlap: Column, a: Column, b: Column, n: Column) -> Column:
    """Overlap beyond chance as a phi coefficient; 0 where it is undefined."""
    a, b, n = (x.cast("double") for x in (a, b, n))
    spread = a * (1 - a / n) * b * (1 - b / n)
    ok = (n > 0) & (a > 0) & (b > 0) & (a < n) & (b < n) & (spread > 0)
    return F.when(ok, (overlap - a * b / n) / F.sqrt(spread)).otherwise(0.0)


def correlate(ref: DataFrame, probe: DataFrame, ref_bins: DataFrame, probe_bins: DataFrame, keys: list[str], max_lag: float = 60.0, guard: float = 1.0) -> DataFrame:
    """(keys, lag, overlap, second, correlation, peak_ratio) for each key of both merged interval sets.

    ref_bins, probe_bins: (keys, n_bins). Pairs that never overlap within max_lag get lag 0 and zeros. The reference may lack
    some of the keys; see overlaps().
    """
    x = overlaps(ref, probe, ref_bins, probe_bins, keys, round(max_lag * C.BINS), round(guard * C.BINS))
    corr = F.when(F.col("overlap") > 0, phi(F.col("overlap"), F.col("energy_a"), F.col("energy_b"), F.greatest("_na", "_nb"))).otherwise(0.0)
    ratio = F.when(F.col("overlap") <= 0, 0.0).when(F.col("second") > 0, F.col("overlap") / F.col("second")).otherwise(C.NO_SECOND_PEAK)
    return x.select(*keys, "lag", "overlap", "second", corr.alias("correlation"), ratio.alias("peak_ratio"))


def scale_grid(ref_cues: DataFrame, probe_cues: DataFrame, keys: list[str], onsets: bool = False, scales=C.SCALES, settings: C.Settings = C.DEFAULTS) -> DataFrame:
    """Correlation of the probe under every ratio: correlate()'s columns with scale_ix and scale."""
    make = I.onset_bins if onsets else I.presence_bins
    many = F.explode(F.array(*[F.struct(F.lit(k).alias("scale_ix"), F.lit(float(v)).alias("scale")) for k, v in enumerate(scales)]))
    both = [*keys, "scale_ix"]
    p = probe_cues.withColumn("_g", many).withColumn("scale_ix", F.col("_g.scale_ix")).withColumn("scale", F.col("_g.scale")).drop("_g")
    r_bins = I.lengths(ref_cues, keys)
    p_bins = I.lengths(p, both, F.col("scale"))
    cut = lambda m, n, k: I.clip(m.join(n, k), F.col("n_bins")).drop("n_bins")
    r = cut(I.merge(make(ref_cues.where("stop > start")), keys), r_bins, keys)
    m = cut(I.merge(make(p.where("stop > start"), F.col("scale")), both), p_bins, both)
    out = correlate(r, m, r_bins, p_bins, both, settings.max_search, settings.peak_guard)
    of = F.element_at(F.array(*[F.lit(float(v)) for v in scales]), F.col("scale_ix") + 1)
    return out.withColumn("scale", of)


def best_fit(grid: DataFrame, keys: list[str], margin: float = 0.02) -> DataFrame:
    """Row of the best ratio of each key: highest correlation (ties: earlier ratio); unscaled if within margin of it."""
    row = F.struct("scale_ix", "scale", "lag", "overlap", "correlation", "peak_ratio")
    x = grid.groupBy(*keys).agg(F.max_by(row, F.struct("correlation", -F.col("scale_ix"))).alias("top"), F.max(F.when(F.col("scale_ix") == 0, row)).alias("plain"))
    pick = F.when(F.col("plain").isNotNull() & (F.col("top.correlation") - F.col("plain.correlation") < margin), F.col("plain")).otherwise(F.col("top"))
    return x.select(*keys, pick.alias("f")).select(*keys, "f.*")


def choose_hypothesis(fits: DataFrame, keys: list[str], settings: C.Settings = C.DEFAULTS) -> DataFrame:
    """One representation of each key: those that pass first, then the larger margin, then the earlier.

    fits: (keys, rep_ix, representation, min_correlation, correlation, peak_ratio, ...).
    """
    passes = (F.col("correlation") >= F.col("min_correlation")) & (F.col("peak_ratio") >= settings.min_ratio)
    margin = F.least(F.col("correlation") / F.col("min_correlation"), F.col("peak_ratio") / settings.min_ratio)
    x = fits.withColumn("passes", passes).withColumn("margin", margin)
    others = [c for c in x.columns if c not in keys]
    return x.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct("passes", "margin", -F.col("rep_ix"))).alias("h")).select(*keys, "h.*")


def accepts(correlation: Column, ratio: Column, least: float = 0.5, min_ratio: float = 1.2) -> Column:
    return (correlation >= least) & (ratio >= min_ratio)
