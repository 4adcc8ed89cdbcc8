"""Piecewise offsets: the dynamic program, its blocks, and what they do to lines.

The program rates every cue at every offset and lets the offset change at a price. A cue's rating is piecewise linear in the
offset, so it is kept as the few places where its slope changes: cues meet reference intervals in an equi-join on key and time tile,
which spreads a long track over tasks. The program itself is walked over sorted partitions and holds two numbers an offset; it
passes on, for each cue, the best offset and the cue at which that offset was taken up. With these the path is found backwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervane import config as C
from intervane.functions.rounding import half_even
from intervane.operators import correlate as X
from intervane.operators import intervals as I

_TILE, _PIECE = 4096, 1000
#: Signs of a reference piece's two ends, and slopes at the four places of a cue that they meet.
_UP, _WEIGHT = np.array([1, -1]), np.array([5, -5, 1, -1])
BLOCKS = "array<struct<first_cue:int,last_cue:int,offset:double>>"


def spans(probe_cues: DataFrame, keys: list[str], centre: DataFrame | None = None) -> DataFrame:
    """(keys, cue_ix, a, b, g, first): bins of each cue, of the guard beside it, and the first offset tried. centre: (keys, centre) seconds."""
    c = I.ordered(probe_cues, keys)
    c = c.join(centre, keys, "left") if centre is not None else c.withColumn("centre", F.lit(0.0))
    a = half_even(F.col("start") * C.BINS).cast("long")
    c = c.withColumn("a", a).withColumn("b", F.greatest(F.col("a") + 1, half_even(F.col("stop") * C.BINS).cast("long")))
    first = half_even(F.coalesce("centre", F.lit(0.0)) * C.BINS).cast("long") - round(C.SPLIT_RADIUS * C.BINS)
    return c.select(*keys, "cue_ix", "a", "b", F.least(F.col("b") - F.col("a"), F.lit(C.SPLIT_GUARD)).alias("g"), first.alias("first"))


def met(ref: DataFrame, cues: DataFrame, keys: list[str]) -> DataFrame:
    """cues (spans) with each piece (s, e) of the merged reference that bears on their rating at any offset; a tile without any gives nulls."""
    width = 2 * round(C.SPLIT_RADIUS * C.BINS)
    low, high = F.col("a") - F.col("g") + F.col("first"), F.col("b") + F.col("g") + F.col("first") + width
    tile = lambda x: F.floor(x / _TILE)
    pieces = X._pieces(ref).select(*[F.col(k).alias(f"_{k}") for k in keys], "s", "e", tile(F.col("s")).alias("_p"))
    looks = cues.withColumn("_t", F.explode(F.sequence(tile(low - _PIECE), tile(high))))
    on = (F.col("_t") == F.col("_p")) & (F.col("e") > low) & (F.col("s") < high)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return looks.join(pieces.hint("merge"), on, "left").select(*cues.columns, "s", "e")


def rating(s: np.ndarray, e: np.ndarray, a: int, b: int, g: int, first: int, n: int, out: np.ndarray | None = None) -> np.ndarray:
    """Four times the rating of a cue at n offsets: reference bins under it, less a quarter of those in the guards beside it. out: int64, to be written over."""
    out = np.zeros(n, np.int64) if out is None else out
    out.fill(0)
    edges, up = np.concatenate([s, e]), np.repeat(_UP, len(s))
    at, w = (edges[:, None] - (np.array([b, a, a - g, b + g]) + first)).ravel(), (up[:, None] * _WEIGHT).ravel()
    before = int((w * np.minimum(at, 0)).sum())
    to = np.maximum(at, 0) + 1  # a slope holds from the next offset on
    np.add.at(out, to[to < n], w[to < n])
    np.cumsum(out, out=out)
    out[0] = -before
    return np.cumsum(out, out=out)


def _program(keys: list[str], n: int):
    """Sorted rows of met() to (keys, cue_ix, at, since): the best offset at each cue and the cue at which it was taken up."""
    price = round(4 * C.SPLIT_PENALTY * C.BINS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, top, rest = None, 0, None
        score, since, rate, low = (np.zeros(n, t) for t in (np.int64, np.int64, np.int64, bool))  # written over cue by cue

        def steps(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal key, top
            out = []
            cols = [pdf[c].to_numpy() for c in ("a", "b", "g", "first", "cue_ix")]
            turn = (pdf[[*keys, "cue_ix"]].ne(pdf[[*keys, "cue_ix"]].shift())).any(axis=1).to_numpy()
            cuts = [*np.nonzero(turn)[0].tolist(), len(pdf)]
            s, e = pdf["s"].to_numpy(float), pdf["e"].to_numpy(float)
            missing = np.isnan(s)
            s, e = (np.where(missing, 0, x).astype(np.int64) for x in (s, e))
            of = zip(*(pdf[k].to_numpy()[cuts[:-1]].tolist() for k in keys))
            for x, y, mine, (a, b, g, first, cue) in zip(cuts, cuts[1:], of, zip(*(c[cuts[:-1]].tolist() for c in cols))):
                real = ~missing[x:y]
                rating(s[x:y][real], e[x:y][real], a, b, g, first, n, rate)
                if mine != key:
                    key = mine
                    score[:] = rate
                    since.fill(cue)
                else:
                    leap = top - price
                    np.less(score, leap, out=low)
                    np.copyto(since, cue, where=low)
                    np.maximum(score, leap, out=score)
                    np.add(score, rate, out=score)
                at = int(score.argmax())
                top = int(score[at])
                out.append((*mine, cue, first + at, int(since[at])))
            return pd.DataFrame(out, columns=[*keys, "cue_ix", "at", "since"])

        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            # The last cue may go on in the next batch.
            last = (pdf[[*keys, "cue_ix"]] == pdf[[*keys, "cue_ix"]].iloc[-1]).all(axis=1).to_numpy()
            rest = pdf[last].reset_index(drop=True)
            if not last.all():
                yield steps(pdf[~last].reset_index(drop=True))
        if rest is not None and len(rest):
            yield steps(rest)

    return run


def paths(best: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, blocks): from the last cue back, each block begins where its offset was taken up. A track's cues are one small array."""
    back = F.sort_array(F.collect_list(F.struct("cue_ix", "at", "since")), asc=False)
    x = best.groupBy(*keys).agg(back.alias("_b"))
    none = F.array().cast(BLOCKS)
    block = lambda p: F.struct(p["since"].cast("int").alias("first_cue"), p["cue_ix"].cast("int").alias("last_cue"), (p["at"] / float(C.BINS)).alias("offset"))
    step = lambda acc, p: F.when(p["cue_ix"] == acc["want"], F.struct((p["since"] - 1).cast("long").alias("want"), F.concat(F.array(block(p)), acc["found"]).alias("found"))).otherwise(acc)
    first = F.struct(F.col("_b")[0]["cue_ix"].cast("long").alias("want"), none.alias("found"))
    return x.select(*keys, F.aggregate("_b", first, step)["found"].alias("blocks"))


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, overlap) of two merged interval sets: both cut at the bounds of tiles, joined by tile."""

    def tiles(d: DataFrame, s: str, e: str) -> DataFrame:
        t = d.select(*keys, "s", "e").withColumn("_t", F.explode(F.sequence(F.floor(F.col("s") / _TILE), F.floor((F.col("e") - 1) / _TILE))))
        return t.select(*keys, "_t", F.greatest(F.col("s"), F.col("_t") * _TILE).alias(s), F.least(F.col("e"), (F.col("_t") + 1) * _TILE).alias(e))

    both = tiles(a, "s", "e").join(tiles(b, "s2", "e2").hint("merge"), [*keys, "_t"])
    return both.groupBy(*keys).agg(F.sum(F.greatest(F.least("e", "e2") - F.greatest("s", "s2"), F.lit(0))).alias("overlap"))


def with_blocks(probe_cues: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Probe cues (keys, src_ix, start, stop) of the keys of blocks (keys, blocks), moved by the offset of the block that each is in."""
    cues = I.ordered(probe_cues, keys).join(blocks.select(*keys, "blocks"), keys)
    offset = F.element_at(F.filter("blocks", lambda b: b["first_cue"] <= F.col("cue_ix")), -1)["offset"]
    return cues.withColumn("_o", offset).select(*keys, "src_ix", (F.col("start") + F.col("_o")).alias("start"), (F.col("stop") + F.col("_o")).alias("stop"))


def score(ref: DataFrame, n_bins: DataFrame, probe_cues: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, correlation) of the probe with its blocks' offsets (keys, blocks) applied, over the length of the reference."""
    moved = with_blocks(probe_cues, blocks, keys).where("stop > start")
    again = n_bins.withColumn("n_probe", F.ceil((F.col("n_bins") - 2) / float(C.BINS) * C.BINS) + 2)
    mine = I.clip(I.merge(I.presence_bins(moved), keys).join(again.select(*keys, "n_probe"), keys), F.col("n_probe")).drop("n_probe")
    size = lambda d, n: I.energy(d, keys).select(*keys, F.col("energy").alias(n))
    x = again.join(size(ref, "_a"), keys).join(size(mine, "_b"), keys).join(overlap(ref, mine, keys), keys, "left")
    return x.select(*keys, X.phi(F.coalesce("overlap", F.lit(0)), F.col("_a"), F.col("_b"), F.col("n_bins")).alias("correlation"))


def split(ref_cues: DataFrame, probe_cues: DataFrame, keys: list[str], centre: DataFrame | None = None, total: float = 0.0) -> DataFrame:
    """(keys, correlation, blocks array<struct<first_cue, last_cue, offset>>) of the best path over offsets.

    Keys are those with cues on both sides. centre: (keys, centre) seconds, 0 where missing. total: seconds of the reference, or 0
    for its own. A reference without any bin gives no blocks and 0. Ties stay at an offset, and go to the lowest one.
    """
    n = 2 * round(C.SPLIT_RADIUS * C.BINS) + 1
    own = I.lengths(ref_cues, keys)
    n_bins = own.select(*keys, F.lit(max(2, int(np.ceil(total * C.BINS)) + 2)).cast("long").alias("n_bins")) if total > 0 else own
    ref = I.clip(I.merge(I.presence_bins(ref_cues.where("stop > start")), keys).join(n_bins, keys), F.col("n_bins")).drop("n_bins")
    cues = spans(probe_cues, keys, centre).join(ref.select(*keys).distinct(), keys, "left_semi")
    rows = met(ref, cues, keys).repartition(*keys).sortWithinPartitions(*keys, "cue_ix")
    kinds = dict(rows.dtypes)
    types = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    found = paths(rows.mapInPandas(_program(keys, n), f"{types}, cue_ix long, at long, since long"), keys)
    both = own.select(*keys).join(probe_cues.where("stop > start").select(*keys).distinct(), keys)
    out = both.join(found, keys, "left").join(score(ref, n_bins, probe_cues, found, keys), keys, "left")
    return out.select(*keys, F.coalesce("correlation", F.lit(0.0)).alias("correlation"), F.coalesce("blocks", F.array().cast(BLOCKS)).alias("blocks"))


def islands(offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of equal offset along cue_ix as blocks (keys, block_ix, first_cue, last_cue, offset)."""
    w = Window.partitionBy(*keys).orderBy("cue_ix")
    turn = (F.lag("offset").over(w).isNull() | (F.lag("offset").over(w) != F.col("offset"))).cast("int")
    x = offsets.withColumn("_t", turn).withColumn("block_ix", F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return x.groupBy(*keys, "block_ix").agg(F.min("cue_ix").alias("first_cue"), F.max("cue_ix").alias("last_cue"), F.first("offset").alias("offset"))


def block_offsets(cues: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """cues with the offset of the block that contains cue_ix; the last block also takes what lies beyond it.

    Both sides are put in one ordered stream and the latest block start is carried forward: no range join.
    """
    marks = blocks.select(*keys, F.col("first_cue").alias("cue_ix"), F.col("offset").alias("_o"), F.lit(0).alias("_k"))
    both = cues.withColumn("_o", F.lit(None).cast("double")).withColumn("_k", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("cue_ix", "_k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("offset", F.last("_o", ignorenulls=True).over(w)).where("_k = 1").drop("_o", "_k")


def carry_forward(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines without an offset take the last one before them, and those before any the first block's (column seed)."""
    w = Window.partitionBy(*keys).orderBy("line_ix").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("offset", F.coalesce(F.last("offset", ignorenulls=True).over(w), F.col("seed")))


def credible(x: DataFrame, settings: C.Settings = C.DEFAULTS) -> DataFrame:
    """Adds credible: x has blocks, split_correlation, min_correlation, global_correlation, split_coverage, global_coverage."""
    n = F.size("blocks")
    ok = (
        (n > 1)
        & (n <= settings.max_blocks)
        & F.forall("blocks", lambda b: b["last_cue"] - b["first_cue"] + 1 >= settings.min_block_cues)
        & (F.col("split_correlation") >= F.col("min_correlation"))
        & (F.col("split_correlation") > F.col("global_correlation") + settings.split_gain)
        & (F.col("split_coverage") >= settings.min_piecewise_coverage)
        & (F.col("global_coverage").isNull() | (F.col("split_coverage") > F.col("global_coverage") + settings.min_coverage_gain))
    )
    return x.withColumn("credible", F.coalesce(ok, F.lit(False)))
