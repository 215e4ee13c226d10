"""A store's rules as a stream: a Python data source whose offset is the library's version, for hosts that follow it."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators import library

SCHEMA = library.RULE + ", rule_ord int, content string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def newest(root: str) -> dict | None:
    """The last manifest of a store, None before its first commit."""
    fs, path = opened(root)
    folder = f"{path}/_manifests"
    if fs.get_file_info(folder).type != pafs.FileType.Directory:
        return None
    names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.path.endswith(".json"))
    if not names:
        return None
    with fs.open_input_file(names[-1]) as f:
        return json.loads(f.read())


@dataclass
class Part(InputPartition):
    """A file of rules, and the versions wanted: beyond the first, up to the second."""

    file: str
    low: int
    high: int


class ChangeReader(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:  # noqa: N802
        return {"version": -1}  # builtin rules have version 0

    def latestOffset(self) -> dict:  # noqa: N802
        found = newest(self.root)
        return {"version": found["version"] if found else -1}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        """The files of the last commit: they have the newest state of each rule, and a rule that changed again comes with its later version."""
        if start["version"] >= end["version"]:
            return []
        fs, path = opened(self.root)
        files = [f.path for folder in newest(self.root)["tables"].get("rules", []) for f in fs.get_file_info(pafs.FileSelector(f"{path}/{folder}")) if f.path.endswith(".parquet") and not posixpath.basename(f.path).startswith(("_", "."))]
        return [Part(f, start["version"], end["version"]) for f in files]

    def read(self, partition: Part) -> Iterator[tuple]:
        fs, _ = opened(self.root)
        with fs.open_input_file(partition.file) as f:
            for b in pq.ParquetFile(f).iter_batches(columns=NAMES):
                for row in zip(*(b.column(n).to_pylist() for n in NAMES), strict=True):
                    if partition.low < (row[NAMES.index("version")] or 0) <= partition.high:
                        yield row

    def commit(self, end: dict) -> None:
        pass


class RuleChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rulechanges"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChangeReader:  # noqa: N802
        return ChangeReader(self.options["path"])


def rule_changes(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the store's rules as they change, each change once, with `state`: live or deleted. root: the store's folder."""
    spark.dataSource.register(RuleChanges)
    rows = spark.readStream.format("rulechanges").option("path", root).load()
    return rows.withColumn("state", F.when(F.col("enabled") & ~F.col("deleted"), "live").otherwise("deleted"))
