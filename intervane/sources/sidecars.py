"""Files written byte for byte by a data source with commit and abort: format "sidecars".

Each task writes its files to a folder of its own beside their places; only when all tasks have ended well are they moved there.
A failed task, or two rows of one name, leave nothing. The folder must be one that the driver and the executors share.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where each is, and its name


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.top = options["path"]
        self.staging = os.path.join(self.top, f".staging-{uuid.uuid4().hex}")

    def write(self, rows):
        own = os.path.join(self.staging, uuid.uuid4().hex)
        os.makedirs(own)
        files = []
        for k, row in enumerate(rows):
            name = os.path.normpath(row["name"])
            if os.path.isabs(name) or name.startswith(".."):
                raise ValueError(f"not a name below the folder: {row['name']}")
            at = os.path.join(own, str(k))
            with open(at, "wb") as f:
                f.write(bytes(row["content"] or b""))
            files.append((at, name))
        return _Written(files)

    def commit(self, messages):
        files = [f for m in messages if m for f in m.files]
        names = [n for _, n in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows of one name")
        for at, name in files:
            to = os.path.join(self.top, name)
            os.makedirs(os.path.dirname(to), exist_ok=True)
            os.replace(at, to)
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self):
        for folder, _, names in os.walk(self.staging, topdown=False):
            for n in names:
                os.remove(os.path.join(folder, n))
            os.rmdir(folder)


class SidecarSink(DataSource):
    """One file for each row (name, content)."""

    @classmethod
    def name(cls):
        return "sidecars"

    def schema(self):
        return "name string, content binary"

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def write(docs: DataFrame, path: str) -> None:
    """One file for each row (name, below path; content string or binary), UTF-8 without byte-order mark; files of these names are replaced."""
    docs.sparkSession.dataSource.register(SidecarSink)
    docs.select("name", F.col("content").cast("binary").alias("content")).write.format("sidecars").option("path", path).mode("append").save()


def superseded(owned: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """(key, path) of our earlier files (key, path) of items that a new one (key, path) was written for, under another name: the list to remove."""
    new = written.select(key, F.col("path").alias("_new"))
    left = owned.select(key, "path").distinct().join(new.select(key).distinct(), key, "left_semi")
    return left.join(new, (left[key] == new[key]) & (left["path"] == new["_new"]), "left_anti")
