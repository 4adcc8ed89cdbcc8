"""The keyed store and the sink of sidecars."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from intervane.sources import sidecars
from intervane.sources.keyed import KeyedStore


def test_store_keeps_the_latest_row_of_a_key(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), "k long, v string, n int", ("k",), buckets=3)
    assert store.get().count() == 0
    rows = lambda: sorted(map(tuple, store.get().collect()))
    frame = lambda *r: spark.createDataFrame(list(r), "k long, v string, n int")
    store.put(frame((1, "a", 1), (2, "b", 1), (3, None, None), (2, "c", 1)))
    store.put(frame((2, "d", 2)))
    store.clear(frame((3, None, None), (9, None, None)))
    assert rows() == [(1, "a", 1), (2, "d", 2)]
    store.compact()
    assert rows() == [(1, "a", 1), (2, "d", 2)] and len(store.segments()) == 1
    store.put(frame((3, "new", 3)))
    store.compact()
    assert rows() == [(1, "a", 1), (2, "d", 2), (3, "new", 3)]


def test_store_has_few_files_and_a_failed_write_leaves_nothing(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), "k long, v long", ("k",), buckets=4)
    store.put(spark.range(1_000_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")))
    files = [n for _, _, names in os.walk(tmp_path / "segments") for n in names if n.endswith(".parquet")]
    assert len(files) <= 4 and store.get().agg(F.sum("v")).first()[0] == 999_999 * 1_000_000
    bad = spark.range(10).select(F.col("id").alias("k"), F.expr("assert_true(id < 5)").cast("long").alias("v"))
    with pytest.raises(Exception, match="assert|is not true"):
        store.put(bad)
    assert store.get().count() == 1_000_000 and len(store.segments()) == 1


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), "k long, v string", ("k",), buckets=2)
    work = [threading.Thread(target=lambda w=w: store.put(spark.createDataFrame([(w * 10 + i, f"w{w}") for i in range(5)], "k long, v string"))) for w in range(6)]
    for t in work:
        t.start()
    store.compact()
    for t in work:
        t.join()
    store.compact()
    assert sorted(map(tuple, store.get().collect())) == [(w * 10 + i, f"w{w}") for w in range(6) for i in range(5)]


def test_sidecars_are_written_byte_for_byte(spark, tmp_path):
    texts = {"a/one.ja.ass": "é\r\n日本\n", "two.ja.srt": "", "a/b/three.srt": "x" * 100_000}
    sidecars.write(spark.createDataFrame(list(texts.items()), "name string, content string").repartition(3), str(tmp_path))
    assert {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()} == {n: t.encode() for n, t in texts.items()}
    sidecars.write(spark.createDataFrame([("two.ja.srt", "again")], "name string, content string"), str(tmp_path))
    assert (tmp_path / "two.ja.srt").read_text() == "again"


@pytest.mark.parametrize("rows", [[("ok.srt", "1"), ("../out.srt", "2")], [("twice.srt", "1"), ("twice.srt", "2")]])
def test_a_failed_write_leaves_no_file(spark, tmp_path, rows):
    with pytest.raises(Exception, match="name"):
        sidecars.write(spark.createDataFrame(rows, "name string, content string").repartition(2), str(tmp_path))
    assert not list(tmp_path.rglob("*"))


def test_superseded_files(spark):
    owned = spark.createDataFrame([(1, "/a.1.srt"), (1, "/a.srt"), (2, "/b.srt"), (1, "/a.1.srt")], "item int, path string")
    got = sidecars.superseded(owned, spark.createDataFrame([(1, "/a.srt")], "item int, path string"), "item")
    assert [tuple(r) for r in got.collect()] == [(1, "/a.1.srt")]
