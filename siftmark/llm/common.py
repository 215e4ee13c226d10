"""What the operators share: word rules, hashing, shared storage and exchange of packed arrays."""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..sources.shared import filesystem, map_file, shared_dir, write_file  # noqa: F401

#: bytes.split() cuts at exactly 0x20 and 0x09-0x0D, the white space of the word rule; UTF-8 keeps other characters above 0x7F.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
U64 = np.uint64


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_place(df: DataFrame, name: str) -> int:
    """The place of a column, by Spark's rule for names: without regard to case unless the session asks for it."""
    fold = (lambda c: c) if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true" else str.lower
    return next(i for i, c in enumerate(df.columns) if fold(c) == fold(name))


def with_columns(df: DataFrame, **kinds: str) -> StructType:
    """df's schema and more columns; as a type, whatever the names in it are."""
    return StructType([*df.schema.fields, *(StructField(n, _parse_datatype_string(k)) for n, k in kinds.items())])


def mapped(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """df.mapInArrow(), whose function finds columns by place, for columns of any names."""
    return df.toDF(*(f"_{i}" for i in range(len(df.columns)))).mapInArrow(run, schema)


def keyed(df: DataFrame, run: Callable, key: str, others: list[str], kinds: dict[str, str]) -> DataFrame:
    """(key, kinds) of run over the columns key and others, found by place, for columns of any names; run calls the key's column `key`."""
    places = [column_place(df, c) for c in (key, *others)]
    rows = df.toDF(*(f"_{i}" for i in range(len(df.columns)))).select(*(f"_{i}" for i in places))
    schema = StructType([StructField("key", df.schema[places[0]].dataType), *(StructField(n, _parse_datatype_string(k)) for n, k in kinds.items())])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", df.columns[places[0]])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give a task's freed memory back to the system, as a worker process lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not with every C library
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer, so that sums and products of hashes spread over all bits."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


WHITE = np.array([c in b"\x20\x09\x0a\x0b\x0c\x0d" for c in range(256)])
TURN = 1 << 15  # words hashed at once
SHORT = 64  # bytes; longer words are hashed one by one
MASKS = np.array([*((1 << 8 * i) - 1 for i in range(8)), 2**64 - 1], U64)  # of the first i of eight bytes


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; for all places but the last seven."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of some spans of the bytes `data`, which go on for eight bytes behind the last span.

    Eight bytes at a time are mixed into all spans that are not over yet; spans over SHORT bytes go to xxh3. Neither is a
    polynomial, whose collisions modulo 2**64 can be written down.
    """
    h = size.astype(U64) * U64(0x9E3779B97F4A7C15)
    words = eights(data)
    live, k = (slice(None) if not len(size) or size.max() <= SHORT else np.flatnonzero(size <= SHORT)), 0
    while k < SHORT:
        left = size[live] - k
        h[live] = mix(h[live] ^ (words[starts[live] + k] & MASKS[np.minimum(left, 8)]))
        k += 8
        live = np.flatnonzero((size > k) & (size <= SHORT)) if isinstance(live, slice) else live[left > 8]
        if not len(live):
            break
    for i in np.flatnonzero(size > SHORT).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + size[i]])
    return h


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, with A-Z as a-z, and how many words each text has."""
    data = np.frombuffer(b"\n".join([b"", *raws, b"\n" * 8]).translate(LOWER), np.uint8)
    white = WHITE[data]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    starts, size = edge[0::2], edge[1::2] - edge[0::2]
    h = np.empty(len(starts), U64)
    for i in range(0, len(starts), TURN):  # in turns whose arrays stay in the processor's cache
        h[i : i + TURN] = span_hashes(data, starts[i : i + TURN], size[i : i + TURN])
    last = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)
    return h, np.diff(np.concatenate([[0], np.searchsorted(starts, last)]))


def shingles(h: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of the windows of `width` words, in place order; fewer words make one shingle of all, none makes none."""
    if not len(h):
        return h
    w = min(width, len(h))
    n = len(h) - w + 1
    out = np.full(n, U64(w), U64)
    for i in range(w):
        out = (out ^ h[i : i + n]) * U64(0x9E3779B97F4A7C15)
        out ^= out >> U64(29)
    return mix(out)


def shingle_lists(raws: list[bytes], width: int = 5, step: int = 1 << 20) -> Iterator[np.ndarray]:
    """shingles() of each text, in turns of some MB of texts."""
    at = 0
    while at < len(raws):
        end, size = at, 0
        while end < len(raws) and (end == at or size + len(raws[end]) <= step):
            size += len(raws[end])
            end += 1
        h, n = word_hashes(raws[at:end])
        windows = shingles(h, width)
        first = 0
        for k in n.tolist():
            yield windows[first : first + k - width + 1] if k >= width else shingles(h[first : first + k], width)
            first += k
        at = end


def texts(batch: pa.RecordBatch | pa.Table, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def packed(df: DataFrame, n: int, emit: Callable, merge: Callable, schema: str) -> DataFrame:
    """A shuffle of packed arrays: emit(batches) yields (shard, bytes), merge(shard, blobs) yields record batches.

    Rows of the exchange are whole arrays, pre-aggregated by the sending task; each shard goes to the partition of its number.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in emit(batches):
            shards, blobs = zip(*some, strict=True) if some else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])
        release()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(s, []).append(x)
        for s in sorted(by):
            yield from merge(s, by.pop(s))
        release()

    sent = df.mapInArrow(send, "shard int, blob binary")
    return sent.repartitionById(n, F.col("shard")).mapInArrow(take, schema)


def ordered_parts(df: DataFrame, key: str, n: int) -> tuple[DataFrame, list[int]]:
    """df with column `part`: ranges of an integer key in ascending order; the second value gives each part's first key.

    The bounds are keys that occur, from a mergeable quantile summary over all rows, so they are at most n numbers on the driver.
    """
    share = [i / n for i in range(1, n)]
    got = df.agg(F.min(key).alias("low"), F.percentile_approx(key, F.lit(share), 20_000).alias("cuts") if share else F.array().alias("cuts")).first()
    bounds = [] if got["low"] is None else sorted({got["low"], *(got["cuts"] or [])})

    place, names = column_place(df, key), [*(f"_{i}" for i in range(len(df.columns))), "part"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array(bounds[1:], np.int64)
        for b in batches:
            k = b.column(place).cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.searchsorted(cuts, k, "right").astype(np.int32))], names)

    return mapped(df, assign, with_columns(df, part="int")), bounds
