"""An adaptive noise floor over frames, without walking a whole track in one task.

Each frame moves the floor towards its energy, fast when it falls and slowly when it rises: an increasing map of the floor, of two
straight pieces that meet at the energy. Maps of this kind compose to increasing maps of straight pieces, and composition is
associative, so a block of frames is one map, known without the floor before it. A track is cut into blocks; each is summed up by
a task of its own, the blocks' maps are applied one after the other to the first floor, with no state but the floor, and each block
is then walked by itself from its own first floor.

Frames: key columns, frame_no long, energy double; frames without a positive energy leave the floor as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# First floor, share of the way to a lower and to a higher energy.
FIRST, FALL, RISE = 1e-6, 0.05, 0.001
BLOCK = 256


class Bent:
    """An increasing map of straight pieces: points (x, y) at which its slope changes, and its slopes before and after them all."""

    def __init__(self, x=(), y=(), before: float = 1.0, after: float = 1.0):
        self.x, self.y, self.before, self.after = np.asarray(x, float), np.asarray(y, float), before, after

    def __call__(self, at):
        at = np.asarray(at, float)
        if not len(self.x):
            return at  # without points the map is the identity
        inside = np.interp(at, self.x, self.y)
        low, high = self.y[0] + (at - self.x[0]) * self.before, self.y[-1] + (at - self.x[-1]) * self.after
        return np.where(at < self.x[0], low, np.where(at > self.x[-1], high, inside))

    def back(self, y: float) -> float:
        """Where the map is y."""
        if not len(self.x):
            return y
        if y < self.y[0]:
            return float(self.x[0] + (y - self.y[0]) / self.before)
        if y > self.y[-1]:
            return float(self.x[-1] + (y - self.y[-1]) / self.after)
        return float(np.interp(y, self.y, self.x))

    def then(self, other: Bent) -> Bent:
        """This map, and after it the other: bends of this one, and those of the other where this one reaches them."""
        x = np.concatenate([self.x, [self.back(y) for y in other.x]])
        y = np.concatenate([other(self.y), other.y])
        order = np.argsort(x, kind="stable")
        return Bent(x[order], y[order], self.before * other.before, self.after * other.after)


def frame_map(energy: float) -> Bent:
    """What one frame does to the floor: it goes up slowly from below its energy and down fast from above."""
    return Bent([energy], [energy], 1 - RISE, 1 - FALL) if energy > 0 else Bent()


def _types(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def _blocks(frames: DataFrame, keys: list[str], then, schema: str, *more: str) -> DataFrame:
    """then(rows, of, place, first, energy) of many blocks at once, over partitions sorted by block and frame.

    rows: whole blocks. of: the block of each row, place: its place there; first: the first row of each; energy: (blocks, frames) with zeros, which
    leave the floor as it is, behind shorter ones.
    """
    on = [*keys, "block"]

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        turn = pdf[on].ne(pdf[on].shift()).any(axis=1).to_numpy()
        turn[0] = True
        first = np.nonzero(turn)[0]
        of = np.cumsum(turn) - 1
        place = np.arange(len(pdf)) - first[of]
        energy = np.zeros((len(first), int(place.max()) + 1))
        energy[of, place] = pdf["energy"].fillna(0.0)
        return then(pdf, of, place, first, energy)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            # The last block may go on in the next batch.
            last = (pdf[on] == pdf[on].iloc[-1]).all(axis=1).to_numpy()
            rest = pdf[last].reset_index(drop=True)
            if not last.all():
                yield steps(pdf[~last].reset_index(drop=True))
        if rest is not None and len(rest):
            yield steps(rest)

    rows = frames.dropna(subset=keys).select(*on, "frame_no", "energy", *more)
    return rows.repartition(F.xxhash64(*on)).sortWithinPartitions(*on, "frame_no", "energy").mapInPandas(run, f"{_types(frames, keys)}, {schema}")


def _numbered(frames: DataFrame, keys: list[str], block: int) -> DataFrame:
    return frames.select(*keys, "frame_no", "energy", F.floor(F.col("frame_no") / block).alias("block"))


def composed(energy: np.ndarray) -> list[Bent]:
    """The map of each row of frames, frame_map() after frame_map(), all rows at once."""
    n, most = energy.shape
    x, y = np.full((n, most), np.inf), np.full((n, most), np.inf)  # points in order, those still missing at the end
    size, before, after = np.zeros(n, int), np.ones(n), np.ones(n)
    for e in energy.T:
        on = np.nonzero(e > 0)[0]
        if not len(on):
            continue
        e, k, xs, ys = e[on], size[on], x[on], y[on]
        r, none = np.arange(len(on)), k == 0
        at = (ys < e[:, None]).sum(axis=1)  # points below the energy
        lo, hi = np.clip(at - 1, 0, most - 1), np.clip(at, 0, most - 1)
        end = np.maximum(k - 1, 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            inside = xs[r, lo] + (xs[r, hi] - xs[r, lo]) * ((e - ys[r, lo]) / (ys[r, hi] - ys[r, lo]))
            low, high = xs[:, 0] + (e - ys[:, 0]) / before[on], xs[r, end] + (e - ys[r, end]) / after[on]
            back = np.where(none, e, np.where(at == 0, low, np.where(at >= k, high, inside)))
            moved = e[:, None] + (ys - e[:, None]) * np.where(ys < e[:, None], 1 - RISE, 1 - FALL)
        order = np.arange(most)
        shift = order > at[:, None]
        x[on] = np.where(order == at[:, None], back[:, None], np.where(shift, np.roll(xs, 1, axis=1), xs))
        y[on] = np.where(order == at[:, None], e[:, None], np.where(shift, np.roll(moved, 1, axis=1), moved))
        size[on] = k + 1
        before[on] *= 1 - RISE
        after[on] *= 1 - FALL
    return [Bent(x[i, : size[i]], y[i, : size[i]], before[i], after[i]) for i in range(n)]


def block_maps(frames: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, block, x, y, before, after): the map of each block of frame numbers."""

    def then(pdf, of, place, first, energy):
        maps = composed(energy)
        rows = pdf[[*keys, "block"]].iloc[first]
        return rows.assign(x=[m.x for m in maps], y=[m.y for m in maps], before=[m.before for m in maps], after=[m.after for m in maps])

    return _blocks(_numbered(frames, keys, block), keys, then, "block long, x array<double>, y array<double>, before double, after double")


def first_floors(maps: DataFrame, keys: list[str], first: float = FIRST) -> DataFrame:
    """(keys, block, floor): the floor before each block. Sorted partitions are walked with one number as the state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, floor = None, first
        for pdf in batches:
            out = []
            for *key, x, y, before, after in zip(*(pdf[k] for k in keys), pdf["x"], pdf["y"], pdf["before"], pdf["after"]):
                if key != now:
                    now, floor = key, first
                out.append(floor)
                floor = float(Bent(x, y, before, after)(floor))
            yield pdf[[*keys, "block"]].assign(floor=out)

    walked = maps.repartition(*keys).sortWithinPartitions(*keys, "block")
    return walked.mapInPandas(run, f"{_types(maps, keys)}, block long, floor double")


def floors(frames: DataFrame, keys: list[str], block: int = BLOCK, first: float = FIRST) -> DataFrame:
    """(keys, frame_no, floor): the floor after each frame. frames is read twice. Frames of one number follow each other by energy."""
    before = first_floors(block_maps(frames, keys, block), keys, first)

    def then(pdf, of, place, first, energy):
        floor, out = pdf["floor"].to_numpy(float)[first], np.empty_like(energy)
        for k, e in enumerate(energy.T):
            rate = np.where(e < floor, FALL, RISE)
            floor = np.where(e > 0, (1 - rate) * floor + rate * e, floor)
            out[:, k] = floor
        return pdf[[*keys, "frame_no"]].assign(floor=out[of, place])

    numbered = _numbered(frames, keys, block).join(before.hint("merge"), [*keys, "block"])
    return _blocks(numbered, keys, then, "frame_no long, floor double", "floor")
