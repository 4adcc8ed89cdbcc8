"""Every registered query outside the llm subpackage against its SQL, on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from intervane.plans import catalogue

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    r = duck.sql(catalogue.ORACLES[name])
    names = list(r.columns)
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())


def test_rows_only_queries_recover_what_was_done(spark):
    got = catalogue.QUERIES["align_verdicts"](spark, SF).collect()
    assert all(abs(r.shift + ((r.track_id * 37) % 4001 - 2000) / 100) < 0.011 for r in got if r.verdict != "Declined")
    assert sum(r.verdict != "Declined" for r in got) >= len(got) * 0.8
    assert catalogue.QUERIES["piecewise_dp"](spark, SF).count() >= 15
    assert catalogue.QUERIES["consensus_tracks"](spark, SF).where("chosen").count() == 15
    assert catalogue.QUERIES["sync_pipeline"](spark, SF).count() == 15


def test_stream_equals_batch(spark):
    rows = lambda n: sorted(map(tuple, catalogue.QUERIES[n](spark, SF).select("k", "seq", "admitted_ms").collect()))
    assert rows("rate_limiter_stream") == rows("rate_limiter")


@pytest.mark.parametrize("files", [1, 3])
def test_stream_equals_batch_where_a_key_comes_in_parts(spark, tmp_path, files):
    """A micro-batch gives a key's events in several parts, in any order; and the table may be a folder of files."""
    import shutil

    spark.read.parquet(f"{SF}/events.parquet").orderBy(F.xxhash64("event_id")).repartition(files).write.parquet(str(tmp_path / "made"))
    made = sorted((tmp_path / "made").glob("part-*"))
    assert len(made) == files
    if files == 1:
        shutil.move(made[0], tmp_path / "events.parquet")
    else:
        shutil.move(tmp_path / "made", tmp_path / "events.parquet")
    rows = lambda n: sorted(map(tuple, catalogue.QUERIES[n](spark, str(tmp_path)).select("k", "seq", "admitted_ms").collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        got = rows("rate_limiter_stream")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) > 500 and got == rows("rate_limiter")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 15 and set(e.oracle_sql()) <= set(e.queries())
