"""Folders as a Spark source: every file, hidden ones too, without version-control and build folders and over-long files.

spark.read.format("filetree").option("path", uri).load() reads any store pyarrow can open. Each partition walks its own
subtrees on the executors; the driver lists the top folders only.
"""

import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.fixed import SKIP_DIRS

SCHEMA = "path string, length long, modificationTime timestamp, content binary"
MAX_FILE = 50 << 20
TREES, BATCH = 64, 16 << 20


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def skipped(path: str) -> bool:
    """Any part of the path is a folder to leave out, those above the root included."""
    return any(p in SKIP_DIRS for p in path.split("/"))


@dataclass
class Trees(InputPartition):
    """Folders to walk, and files to read as they are."""

    folders: list[str]
    files: list[str]


class FileTreeReader(DataSourceReader):
    def __init__(self, uri: str, most: int):
        self.uri, self.most = uri, most

    def partitions(self) -> list[Trees]:
        fs, root = opened(self.uri)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        if skipped(root):
            return [Trees([], [])]
        if info.is_file:
            return [Trees([], [root])]  # a lone file has no limit of size
        folders, files = [root], []
        for _ in range(3):  # widen until there are subtrees enough
            if len(folders) >= TREES:
                break
            below = []
            for f in folders:
                for x in fs.get_file_info(pafs.FileSelector(f)):
                    if x.type == pafs.FileType.Directory:
                        below += [] if skipped(x.base_name) else [x.path]
                    elif x.is_file and x.size <= self.most and not skipped(x.base_name):
                        files.append(x.path)
            folders = below
        step = max(1, -(-len(files) // TREES))
        trees = [Trees([f], []) for f in sorted(folders)] + [Trees([], files[i : i + step]) for i in range(0, len(files), step)]
        return trees or [Trees([], [])]  # Spark calls read() at least once

    def read(self, part: Trees) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.uri)
        rows, size = [], 0
        for info in self.walk(fs, part):
            with fs.open_input_file(info.path) as f:
                data = f.read()
            rows.append((info.path, len(data), info.mtime, data))
            size += len(data)
            if size >= BATCH:
                yield self.batch(rows)
                rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def walk(self, fs: pafs.FileSystem, part: Trees) -> Iterator[pafs.FileInfo]:
        yield from fs.get_file_info(part.files)
        waiting = list(part.folders)
        while waiting:
            for x in sorted(fs.get_file_info(pafs.FileSelector(waiting.pop())), key=lambda x: x.path):
                if skipped(x.base_name):
                    continue
                if x.type == pafs.FileType.Directory:
                    waiting.append(x.path)
                elif x.is_file and x.size <= self.most:
                    yield x

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "length", "modificationTime", "content"])


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileTreeReader:
        return FileTreeReader(self.options["path"], int(self.options.get("maxFileSize", MAX_FILE)))


def read_tree(spark: SparkSession, root: str, max_file: int = MAX_FILE) -> DataFrame:
    """(path, length, modificationTime, content) of the files under root."""
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").option("path", root).option("maxFileSize", str(max_file)).load()


def hadoop(spark: SparkSession, uri: str):
    """The store's file system and the path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def publish(spark: SparkSession, uri: str, text: str) -> bool:
    """Writes a small file that must not exist yet; False if it does.

    Local files are linked into place, which is one step; other stores create without overwriting.
    """
    fs, path = hadoop(spark, uri)
    fs.mkdirs(path.getParent())
    if fs.getScheme() == "file":
        final = path.toUri().getPath()
        mine = f"{final}.{uuid.uuid4().hex}"
        with open(mine, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(mine, final)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(mine)
    try:
        out = fs.create(path, False)
    except Py4JJavaError as e:
        if "Exist" in e.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def content(spark: SparkSession, uri: str) -> str:
    """A small file's text."""
    fs, path = hadoop(spark, uri)
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def base_name(path: str) -> str:
    return posixpath.basename(path.replace("\\", "/"))
