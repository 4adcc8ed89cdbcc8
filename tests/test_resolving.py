"""Reference caches and range sums against step-by-step loops."""

import random

from intervane.operators import intervals as I
from intervane.operators import resolve as RE


def test_cache_hits_goes_stale_and_evicts_the_oldest(spark):
    r = random.Random(6)
    rows = [(c, i, r.randrange(9), f"/p{r.randrange(2)}" if r.random() < 0.9 else None, r.randrange(2)) for c in ("a", "b") for i in range(400)]
    table = spark.createDataFrame(rows, "cache string, seq long, item long, path string, stamp long").repartition(4)
    got = {(x.cache, x.seq): (x.answered, x.evicted) for x in RE.lookups(table, "cache", 4).collect()}
    kept: dict = {}
    for cache, seq, item, path, stamp in rows:
        own = kept.setdefault(cache, [])
        known = [k for k in own if k[0] == item]
        if known and known[0][1:] == (path or "", stamp):
            assert got[cache, seq] == ("hit", None)
            continue
        kept[cache] = own = [k for k in own if k[0] != item] + [(item, path or "", stamp)]
        out = own.pop(0)[0] if len(own) > 4 else None
        assert got[cache, seq] == ("stale" if known else "new", out)
    assert {x for x, _ in got.values()} == {"hit", "stale", "new"} and any(e is not None for _, e in got.values())


def test_sources_fall_back_to_sound(spark):
    looked = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (1, 6)], "item long, stamp long")
    embedded, sound = looked.where("item = 1 and stamp = 5"), looked.where("item < 3")
    of = lambda allow: [x.source for x in RE.built(looked, embedded, sound, allow).orderBy("stamp", "item").collect()]
    assert of(True) == ["embedded", "sound", "none", "sound"] and of(False) == ["embedded", "none", "none", "none"]


def test_range_sums_are_clamped(spark):
    merged = spark.createDataFrame([(1, 10, 20), (1, 4090, 4100), (1, 9000, 9005)], "k int, s long, e long")
    n = spark.createDataFrame([(1, 9005), (3, 50)], "k int, n_bins long")
    rows = [(1, 1, 0, 15), (1, 2, -5, 4096), (1, 3, 4095, 99999), (1, 4, 12, 13), (2, 5, 0, 9), (1, 6, 30, 20), (3, 7, 0, 50), (1, 8, 99999, 100000)]
    got = {x.id: x.covered for x in I.range_sums(merged, n, spark.createDataFrame(rows, "k int, id int, lo long, hi long"), ["k"]).collect()}
    assert got == {1: 5, 2: 16, 3: 10, 4: 1, 5: 0, 6: 0, 7: 0, 8: 0}
