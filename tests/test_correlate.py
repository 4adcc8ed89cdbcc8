"""The lag search against counting overlaps lag by lag, also where a key's rows go on in the next batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from intervane.operators import correlate as X
from intervane.operators import coverage as CV

LIMIT, GUARD = 300, 20


def track(r, n, start):
    """n disjoint intervals that do not touch."""
    gaps, sizes = r.integers(1, 90, n), r.integers(1, 60, n)
    s = start + np.cumsum(gaps + np.concatenate([[0], sizes[:-1]]))
    return list(zip(s.tolist(), (s + sizes).tolist()))


def counted(a, b):
    """(lag, overlap, second, least) by counting bins at each lag."""
    size = max([e for _, e in a + b]) + LIMIT + 1
    x, y = np.zeros(size + LIMIT, np.int64), np.zeros(size + LIMIT, np.int64)
    for d, v in ((x, a), (y, b)):
        for s, e in v:
            d[s:e] = 1
    on = np.nonzero(y)[0]
    ov = np.array([int(x[(on + lag)[on + lag >= 0]].sum()) for lag in range(-LIMIT, LIMIT + 1)])
    best = int(ov.argmax())
    away = [v for k, v in enumerate(ov) if abs(k - best) > GUARD]
    return (best - LIMIT, int(ov[best]), int(max(away)), int(ov.min())) if ov[best] > 0 else (0, 0, 0, 0)


@pytest.mark.parametrize("rows", [100_000, 3])
def test_every_lag_is_counted(spark, monkeypatch, rows):
    r = np.random.default_rng(11)
    refs = {k: track(r, int(r.integers(1, 30)), int(r.integers(0, 500))) for k in range(12)}
    probes = {(k, j): track(r, int(r.integers(1, 30)), int(r.integers(0, 500))) for k in range(12) for j in range(3)}
    probes[3, 7] = [(90_000, 90_050)]  # never near
    probes[99, 0] = [(1, 2)]  # without a reference
    frame = lambda d, names: spark.createDataFrame([(*(k if isinstance(k, tuple) else (k,)), s, e) for k, v in d.items() for s, e in v], names + ", s long, e long")
    bins = lambda d, names: spark.createDataFrame([(*(k if isinstance(k, tuple) else (k,)), 100_000) for k in d], names + ", n_bins long")
    monkeypatch.setattr(X, "_ROWS", rows)
    monkeypatch.setattr(X, "_MET", rows)
    monkeypatch.setattr(X, "_BLOCK", 5)
    out = X.overlaps(frame(refs, "k long"), frame(probes, "k long, j long"), bins(refs, "k long"), bins(probes, "k long, j long"), ["k", "j"], LIMIT, GUARD).collect()
    got = {(x.k, x.j): x for x in out}
    assert len(got) == len(out) and set(got) == set(probes) - {(99, 0)}
    for (k, j), x in got.items():
        assert (x.lag, x.overlap, x.second, x.least) == counted(refs[k], probes[k, j])
        assert (x.energy_a, x.energy_b) == (sum(e - s for s, e in refs[k]), sum(e - s for s, e in probes[k, j]))


def test_parts_dealt_out_by_key_before_still_meet(spark):
    """Reference, probe and bins come out of exchanges of different sizes; a key's rows meet all the same."""
    ids = spark.range(0, 40_000, 1, 8)
    ref = ids.select((F.col("id") % 4000).alias("k"), (F.col("id") * 7).alias("s")).groupBy("k", "s").agg((F.max("s") + 5).alias("e")).repartition("k")
    n = ref.groupBy("k").agg(F.lit(400_000).alias("n_bins"))
    x = X.correlate(ref, ref, n, n, ["k"])
    assert x.count() == 4000 and x.where("overlap = 50 and lag = 0").count() == 4000


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_sides_that_grow_with_the_cues_are_not_broadcast(spark):
    """Files far smaller than their rows in memory, as ratios and buckets multiply them, went to the driver whole."""
    cues = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("src_ix"), (F.col("id") * 2.0).alias("start"), (F.col("id") * 2.0 + 1).alias("stop"))
    one = cues.select("k", (F.col("src_ix") * 200).alias("s"), (F.col("src_ix") * 200 + 100).alias("e"))
    n = spark.createDataFrame([(k, 20_000) for k in range(3)], "k long, n_bins long")
    assert broadcasts(X.correlate(one, one, n, n, ["k"])) == 0
    needles = cues.select("k", "src_ix", F.col("start").alias("t"))
    assert broadcasts(CV.near(needles, needles, ["k"])) == 0
