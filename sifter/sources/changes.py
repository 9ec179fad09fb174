"""A stream of changed paths below some roots, as a Python stream source.

Format ``changes``, options: ``roots`` (JSON list), ``exclude`` (JSON list of folders), ``since``
(nanoseconds; 0 gives everything once). An offset is a time; a micro-batch has the files and folders
whose own time of change lies between two offsets, the last one ``latency`` seconds back, so that
changes in quick succession come as one. What is added to, removed from or renamed in a folder
changes that folder, which so stands for what is no longer there.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from sifter.sources.catalog import walk

SCHEMA = "path string, changed_ns long"


class Span(InputPartition):
    def __init__(self, root: str, start: int, end: int) -> None:
        self.root, self.start, self.end = root, start, end


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.roots = [os.path.realpath(r) for r in json.loads(options["roots"])]
        self.exclude = [os.path.realpath(x) for x in json.loads(options.get("exclude", "[]"))]
        self.since, self.latency = int(options.get("since", 0)), float(options.get("latency", 1.0))

    def initialOffset(self) -> dict:
        return {"ns": self.since}

    def latestOffset(self) -> dict:
        return {"ns": time.time_ns() - int(self.latency * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Span(r, start["ns"], end["ns"]) for r in self.roots]

    def read(self, partition: Span) -> Iterator[tuple]:
        for path in (partition.root, *walk(partition.root, self.exclude)):
            try:
                at = os.lstat(path)
            except OSError:  # gone meanwhile: its folder tells
                continue
            changed = max(at.st_mtime_ns, at.st_ctime_ns)
            if partition.start < changed <= partition.end:
                yield (path, changed)

    def commit(self, end: dict) -> None:
        pass


class ChangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> ChangeReader:
        return ChangeReader(self.options)


def changes(spark: SparkSession, roots: list[str], exclude: list[str] | None = None, since: int = 0, latency: float = 1.0) -> DataFrame:
    spark.dataSource.register(ChangeSource)
    stream = spark.readStream.format("changes").option("roots", json.dumps(roots)).option("exclude", json.dumps(exclude or []))
    return stream.option("since", str(since)).option("latency", str(latency)).load()
