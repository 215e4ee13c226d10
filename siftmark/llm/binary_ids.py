"""Token ids as files of fixed-width packed integers, with an index of blocks for vectorised unpacking and random access."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_file, ordered_parts, partitions, prepare, release, shared_dir, table, write_file
from .tokenizing import encoder

MAGIC = b"SMIDS001"
BLOCK = 4096  # ids; each block starts at a byte of its own
HEAD = struct.Struct("<8sIIQQ")  # magic, bits per id, ids per block, ids, documents


def width(vocabulary: int) -> int:
    """The least bits that hold every id below `vocabulary`."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of ids in `bits` bits each, lowest bit first."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").view(np.uint8)
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little")


def unpack(data: np.ndarray, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data[: n * bits // 8].tobytes(), f"<u{bits // 8}").astype(np.uint32)
    at = np.arange(n, dtype=np.int64) * bits
    padded = np.concatenate([np.asarray(data), np.zeros(8, np.uint8)])
    byte = at >> 3
    window = sum(padded[byte + i].astype(np.uint64) << np.uint64(8 * i) for i in range((bits + 14) // 8))
    return ((window >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def layout(ids: np.ndarray, starts: np.ndarray, keys: np.ndarray, bits: int) -> list[bytes | np.ndarray]:
    """A file: head, document keys, their starts (and the end), block offsets (and the end), packed blocks."""
    blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks], dtype=np.int64)]).astype("<i8")
    return [HEAD.pack(MAGIC, bits, BLOCK, len(ids), len(keys)), keys.astype("<i8"), starts.astype("<i8"), offsets, *blocks]


class IdFile:
    """Random access to a file of ids through its memory map."""

    def __init__(self, uri: str):
        self.data = map_file(uri)
        magic, self.bits, self.block, self.n, self.documents = HEAD.unpack(self.data[: HEAD.size].tobytes())
        if magic != MAGIC:
            raise ValueError(f"{uri} is no file of packed ids")
        at = HEAD.size

        def longs(n: int) -> np.ndarray:
            nonlocal at
            at += 8 * n
            return np.frombuffer(self.data[at - 8 * n : at].tobytes(), "<i8")

        self.keys, self.starts = longs(self.documents), longs(self.documents + 1)
        self.offsets = longs(-(-self.n // self.block) + 1)
        self.body = self.data[at:]

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids at places start to end: only their blocks are read."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        got = [unpack(self.body[self.offsets[b] : self.offsets[b + 1]], self.bits, min(self.block, self.n - b * self.block)) for b in range(first, last + 1)]
        return np.concatenate(got)[start - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write_ids(df: DataFrame, folder: str, tokenizer: str, spaced: bool, end: int, vocabulary: int) -> DataFrame:
    """Encode documents and write their ids in ascending doc_id order; gives the manifest: file, uri, documents, ids.

    One shuffle, by ranges of doc_id. Null text is empty: just the end id. Null ids count as the smallest key, equal ids are
    ordered by text. A lost task's file is written again with the same bytes. The manifest has a row per file; an empty
    table has no files. A very long text lies in one file, whose ids are in memory while it is written, in 2 or 4 bytes each.
    """
    prepare(df.sparkSession)
    bits = width(vocabulary)
    parts, bounds = ordered_parts(df.select("doc_id", "text"), "doc_id", partitions(df.sparkSession))
    n = max(1, len(bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, spaced, end)
        keys: list[int] = []
        chunks: list[np.ndarray] = []
        part = None

        def close() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum([len(c) for c in chunks], dtype=np.int64)])
            uri = f"{folder}/{part:06d}.ids"
            write_file(uri, layout(np.concatenate(chunks), starts, np.array([k if k is not None else -(2**63) for k in keys], np.int64), bits))
            row = {"file": [part], "uri": [uri], "documents": [len(keys)], "ids": [int(starts[-1])]}
            keys.clear(), chunks.clear()
            return pa.RecordBatch.from_pydict(row, pa.schema([("file", pa.int32()), ("uri", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

        for b in batches:
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                coded = coder.encode([x or "" for x in some.column("text").to_pylist()])
                for p, k, c in zip(some.column("part").to_pylist(), some.column("doc_id").to_pylist(), coded, strict=True):
                    if keys and p != part:
                        yield close()
                    part = p
                    keys.append(k)
                    ids = np.frombuffer(c, "<u4")
                    chunks.append(ids.astype(np.uint16) if bits <= 16 else ids)
        if keys:
            yield close()
        release()

    deal = parts.repartitionById(n, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "text")
    return deal.mapInArrow(run, "file int, uri string, documents long, ids long")


def read_ids(spark: SparkSession, manifest_uri: str) -> DataFrame:
    """A row per document of the written files: doc_id, start, n_tokens, ids_crc32. A file's first id comes from the sizes before it."""
    files = spark.read.parquet(manifest_uri).select("file", "uri", "ids").collect()  # a row per file, not per document
    first, at = {}, 0
    for f in sorted(files, key=lambda f: f["file"]):
        first[f["uri"]], at = at, at + f["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = IdFile(uri)
                keys = pa.array([None if k == -(2**63) else k for k in f.keys.tolist()], pa.int64())
                crc, step = [], 64
                for i in range(0, f.documents, step):  # the blocks of some documents at a time
                    j = min(i + step, f.documents)
                    ids = f.ids(int(f.starts[i]), int(f.starts[j])).astype("<u4")
                    cuts = f.starts[i : j + 1] - f.starts[i]
                    crc += [zlib.crc32(ids[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([keys, pa.array(base + f.starts[:-1], pa.int64()), pa.array(np.diff(f.starts), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                del f
        release()

    rows = spark.createDataFrame([(u, a) for u, a in first.items()], "uri string, first long").repartition(max(1, min(len(first), partitions(spark))))
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-ids")
    written = write_ids(table(spark, sf_dir, "documents"), folder, "byte_bpe_50k.json", True, 0, 50_257)
    written.write.parquet(f"{folder}/manifest")
    return read_ids(spark, f"{folder}/manifest")
