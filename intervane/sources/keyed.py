"""A keyed store of rows in a folder that any Spark file system can hold.

Nothing is ever changed in place. A write adds a segment, a table of at most so many files in which rows are dealt out by a hash of
their key, and then one line to the manifest; a segment without its line is not there for readers, so a failed job leaves nothing
and writers at the same time lose nothing of each other's. Of the rows of one key the latest version counts, ties going to the
later name of a segment. Clearing keys is a write of marks. Compaction writes the present rows as a segment whose line names those
that it stands for: readers leave these out from then on.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LINE = "segment string, version long, replaces array<string>"


@dataclass(frozen=True)
class KeyedStore:
    """Rows of a schema (SQL text) by key columns, below path. buckets: files of a segment at most."""

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = 16

    def segments(self) -> list[tuple[str, int]]:
        """(segment, version) of all that are not replaced: one short line a write since the last compaction, at worst all writes ever."""
        try:
            lines = self.spark.read.schema(_LINE).json(f"{self.path}/manifest/*").collect()
        except Exception as e:  # no write so far
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        gone = {s for line in lines for s in line.replaces or ()}
        return sorted((x.segment, x.version) for x in lines if x.segment not in gone)

    def _add(self, rows: DataFrame, version: int, replaces: tuple[str, ...] = ()) -> None:
        name = uuid.uuid4().hex
        rows.repartition(self.buckets, *self.keys).write.parquet(f"{self.path}/segments/{name}")
        line = self.spark.createDataFrame([(name, version, list(replaces))], _LINE)
        line.coalesce(1).write.json(f"{self.path}/manifest/{name}")  # a folder of its own, so that writers don't meet

    def _next(self) -> int:
        return max((v for _, v in self.segments()), default=0) + 1

    def _names(self) -> list[str]:
        return [n for n in StructType.fromDDL(self.schema).names if n not in self.keys]

    def put(self, rows: DataFrame) -> None:
        """Set the rows of their keys. Of rows with one key the greatest is kept."""
        once = rows.groupBy(*self.keys).agg(F.max(F.struct(*self._names())).alias("_r")).select(*self.keys, "_r.*")
        self._add(once.selectExpr("*", "false _cleared", "cast(null as bigint) _v", "cast(null as string) _s"), self._next())

    def clear(self, keys: DataFrame) -> None:
        """Forget the rows of these keys."""
        kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(self.schema)}
        none = [f"cast(null as {kinds[n]}) `{n}`" for n in self._names()]
        gone = keys.select(*self.keys).distinct().selectExpr("*", *none, "true _cleared", "cast(null as bigint) _v", "cast(null as string) _s")
        self._add(gone, self._next())

    def _latest(self, segments: list[tuple[str, int]]) -> DataFrame:
        """The row of each key that counts, marks of cleared keys too, with the version and the segment (_v, _s) it was written with."""
        versions = F.create_map(*[F.lit(x) for s in segments for x in s])
        read = self.spark.read.schema(f"{self.schema}, _cleared boolean, _v bigint, _s string").parquet(*[f"{self.path}/segments/{s}" for s, _ in segments])
        segment = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        rows = read.withColumn("_in", segment).withColumn("_v", F.coalesce("_v", F.element_at(versions, F.col("_in")))).withColumn("_s", F.coalesce("_s", "_in"))
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*self._names(), "_cleared", "_v", "_s"), F.struct("_v", "_s")).alias("_r"))
        return last.select(*self.keys, "_r.*")

    def get(self) -> DataFrame:
        """The present rows."""
        segments = self.segments()
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        return self._latest(segments).where("not _cleared").select(*StructType.fromDDL(self.schema).names)

    def compact(self) -> None:
        """Put the rows that count together in one segment, as of their own writes, so that writes under way come before or after them as ever."""
        now = self.segments()
        if now:
            self._add(self._latest(now), max(v for _, v in now), tuple(s for s, _ in now))
