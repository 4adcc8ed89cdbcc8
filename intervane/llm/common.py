"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a temporary one if that is unset on a local master (tests)."""
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="intervane-"))
        conf = sc.getCheckpointDir()
    return conf.rstrip("/")


def save(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back. The files outlive lost executors. codec: of the files, by default the session's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/intervane/{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _set(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffles_removed(spark: SparkSession):
    """Within it, the shuffle files of a query go when the query ends, not when the driver collects its garbage. For jobs that save() each step."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession, n_bytes: int = 4_000_000):
    """Within it, an Arrow batch that goes to Python ends at about n_bytes: 10,000 whole texts would be held by the JVM and by Python."""
    return _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(n_bytes))


def docs_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): null texts are empty; all other columns are left behind, so their names cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, rows: int = 256):
    """Small zero-copy parts of an Arrow batch, so that Python holds few texts at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def portions(batch: pa.RecordBatch, column: str, n_bytes: int = 4_000_000):
    """Zero-copy parts of an Arrow batch with about n_bytes of a text column each, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + n_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to


def release() -> None:
    """Give free memory back to the system: a Python worker lives on from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(f):
    """f of one table, with release() after it."""

    def run(table: pa.Table) -> pa.Table:
        out = f(table)
        release()
        return out

    return run


def releasing_pair(f):
    """f of two tables, with release() after it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        release()
        return out

    return run


def releasing_task(run):
    """run of a task's batches, with release() after the last."""

    @wraps(run)
    def all_of(batches):
        yield from run(batches)
        release()

    return all_of


def from_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def bounded_sample(docs: DataFrame, labels: DataFrame, per_class: int, max_chars: int) -> list[tuple[int, str, int]]:
    """At most per_class labelled documents of each class and max_chars characters a class, whole texts, chosen by a hash of doc_id.

    docs: (doc_id, text); labels: (doc_id, label), one class per doc_id (the larger label wins), nulls left out.
    The bound is these two parameters, whatever the size of the corpus. A first text longer than max_chars is still taken.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    lengths = docs.select("doc_id", F.length("text").alias("n")).join(known, "doc_id")
    chosen: dict[int, int] = {}
    for label in (0, 1):
        total = 0
        for r in lengths.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id", "n").limit(per_class).collect():
            if total and total + r.n > max_chars:
                continue
            total += r.n
            chosen[r.doc_id] = label
    if not chosen:
        return []
    ids = spark.createDataFrame(sorted(chosen.items()), "doc_id long, label int")
    out = docs.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label").toArrow()
    return sorted(zip(*(out.column(c).to_pylist() for c in out.column_names)))
