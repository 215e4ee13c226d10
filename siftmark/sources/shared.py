"""Files in the folder that driver and executors share, and batches in pieces."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI under spark.checkpoint.dir, which driver and executors share; set here only where unset (tests, local runs)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def write_file(uri: str, parts: list[bytes | np.ndarray]) -> None:
    """Write under a name of this attempt, then rename, so that a retried task leaves one whole file."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    mine = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(mine) as out:
        for x in parts:
            out.write(memoryview(np.ascontiguousarray(x)).cast("B") if isinstance(x, np.ndarray) and x.size else bytes(x))
    fs.move(mine, path)


def map_file(uri: str) -> np.ndarray:
    """The file's bytes: memory-mapped where the store is a mounted folder, else read."""
    fs, path = filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint8)


def pieces(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of `most` bytes or a row, so that a task holds few rows as Python objects, however full batches are."""
    if batch.num_rows <= 1 or batch.nbytes <= most:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from pieces(batch.slice(0, half), most)
        yield from pieces(batch.slice(half), most)
