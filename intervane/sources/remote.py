"""A read-only data source over listings that a service would give, kept as JSON-lines files: format "listing"."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.options = schema, options

    def partitions(self):
        top = self.options["path"]
        return [_File(os.path.join(top, n)) for n in sorted(os.listdir(top)) if n.endswith(".jsonl")]

    def read(self, partition):
        names = [f.name for f in self.schema.fields]
        with open(partition.path, encoding="utf-8") as f:
            for line in f:
                row = json.loads(line)
                yield tuple(row.get(n) for n in names)


class ListingSource(DataSource):
    """Entries or files of a service: one partition for each page file, columns by name."""

    @classmethod
    def name(cls):
        return "listing"

    def schema(self):
        return "entry_id bigint, name string, url string, size bigint, anime boolean"

    def reader(self, schema):
        return _Reader(schema, self.options)


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    spark.dataSource.register(ListingSource)
    reader = spark.read.format("listing").option("path", path)
    return (reader.schema(schema) if schema else reader).load()


def two_pass(found: DataFrame, keys: list[str]) -> DataFrame:
    """Entries of a search of both kinds: those marked anime, and others only for keys that have none of these."""
    place = F.when(F.coalesce("anime", F.lit(False)), 1).otherwise(2)
    return found.withColumn("_p", place).withColumn("_k", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_p"))).where("_k = 1").drop("_p", "_k")
