"""Packing into fixed-length sequences: vector bin packing by the dot-product heuristic, under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, prepare, table
from .tokenizing import encoder


@dataclass
class Item:
    """Ids [start, end) of an example; ids before `prompt` bear no loss."""

    key: object
    ids: bytes
    total: int
    start: int
    end: int
    prompt: int = 0

    def loss(self, end: int | None = None) -> int:
        return max(0, (self.end if end is None else end) - max(self.start, self.prompt))

    def split(self, n: int) -> tuple[Item, Item]:
        at = self.start + n
        return Item(self.key, self.ids, self.total, self.start, at, self.prompt), Item(self.key, self.ids, self.total, at, self.end, self.prompt)


class Packer:
    """Places examples of a bounded window; sequences are closed as they fill, so memory does not grow with the input.

    limits: tokens, segments and loss-bearing tokens of a sequence. With cut, an example may be cut anywhere: a sequence is then
    filled to its limit, or closed at a power of two. Without, an example is placed whole, and one over a limit is refused.
    """

    def __init__(self, limits: tuple[int, int, int] = (4096, 256, 4096), cut: bool = True, window: int = 1024):
        self.limits, self.cut, self.window = np.array(limits, float), cut, window
        self.pool: list[Item] = []

    def need(self, x: Item) -> tuple[int, int, int]:
        return x.end - x.start, 1, x.loss()

    def add(self, x: Item) -> Iterator[list[Item]]:
        if not self.cut and any(a > b for a, b in zip(self.need(x), self.limits, strict=True)):
            raise ValueError(f"example {x.key} is over a limit: {self.need(x)}")
        self.pool.append(x)
        if len(self.pool) >= self.window:
            yield from self.place(len(self.pool) // 2)

    def finish(self) -> Iterator[list[Item]]:
        yield from self.place(0)

    def place(self, leave: int) -> Iterator[list[Item]]:
        """Close sequences while more than `leave` examples wait."""
        pool, self.pool = self.pool, []
        size = np.array([self.need(x) for x in pool], float).reshape(-1, 3) / self.limits
        live = np.ones(len(pool), bool)
        while (n := int(live.sum())) and n > leave:
            room, chosen = np.ones(3), []
            while live.any():
                fits = live & (size <= room + 1e-12).all(1)
                score = size @ room
                if fits.any():
                    i = int(np.where(fits, score, -1).argmax())
                    chosen.append(pool[i])
                    live[i] = False
                    room = room - size[i]
                elif self.cut and room[0] * self.limits[0] >= 1 and room[1] * self.limits[1] >= 1:
                    i = int(np.where(live, score, -1).argmax())
                    free, loss = round(room[0] * self.limits[0]), round(room[2] * self.limits[2])
                    x = pool[i]
                    n_ids = min(free, max(0, x.prompt - x.start) + loss, x.end - x.start)
                    if n_ids < 1:
                        break
                    head, pool[i] = x.split(n_ids)
                    size[i] = np.array(self.need(pool[i])) / self.limits
                    live[i] = pool[i].end > pool[i].start
                    chosen.append(head)
                    room = room - np.array(self.need(head)) / self.limits
                else:
                    break
            if self.cut:
                pool, size, live = self.trim(chosen, pool, size, live)
            yield chosen
        self.pool = [x for x, on in zip(pool, live, strict=True) if on]

    def trim(self, chosen: list[Item], pool: list[Item], size: np.ndarray, live: np.ndarray) -> tuple[list[Item], np.ndarray, np.ndarray]:
        """Cut a sequence that could not be filled back to a power of two; what is cut off waits again."""
        n = sum(x.end - x.start for x in chosen)
        over = 0 if n >= self.limits[0] else n - (1 << (n.bit_length() - 1))
        while over:
            x = chosen.pop()
            if x.end - x.start > over:
                head, x = x.split(x.end - x.start - over)
                chosen.append(head)
            over -= x.end - x.start
            pool.append(x)
            size = np.vstack([size, np.array(self.need(x), float) / self.limits])
            live = np.append(live, True)
        return pool, size, live


def pack(df: DataFrame, tokenizer: str, spaced: bool, end: int, limits: tuple[int, int, int] = (4096, 256, 4096), cut: bool = True, id_column: str = "doc_id", prompt_column: str | None = None) -> DataFrame:
    """A row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, loss_tokens, sequence_id, offset.

    An example's ids are its prompt's, if a column is named, its text's and the end id; the prompt bears no loss. Null texts are
    empty: just the end id. Each input partition is packed by itself, without a shuffle; its rest is closed at powers of two.
    Repeated ids are packed as often as they occur; of examples that fit equally well the one that waits longest goes first. An
    empty table gives no rows. A very long example is cut over many sequences. sequence_id is the partition's number times 2**32, plus a count.
    """
    prepare(df.sparkSession)
    names = ["start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, first = encoder(tokenizer, spaced, end), encoder(tokenizer, spaced) if prompt_column else None
        packer = Packer(limits, cut)
        base, count = TaskContext.get().partitionId() << 32, 0
        out: list[list] = [[] for _ in range(8)]
        kind = None

        def take(bins: Iterator[list[Item]]) -> None:
            nonlocal count
            for chosen in bins:
                at = 0
                for x in chosen:
                    row = (x.key, x.start, x.end - x.start, x.ids[4 * x.start : 4 * x.end], x.total, x.loss(), base + count, at)
                    for col, v in zip(out, row, strict=True):
                        col.append(v)
                    at += x.end - x.start
                count += 1

        def flush() -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            rb = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["key", *names])
            for c in out:
                c.clear()
            return rb

        for b in batches:
            kind = b.column(0).type
            for i in range(0, b.num_rows, 500):
                some = b.slice(i, 500)
                coded = coder.encode([x or "" for x in some.column(1).to_pylist()])
                prompts = first.encode([x or "" for x in some.column(2).to_pylist()]) if first else [b""] * len(coded)
                for key, p, c in zip(some.column(0).to_pylist(), prompts, coded, strict=True):
                    n = (len(p) + len(c)) // 4
                    take(packer.add(Item(key, p + c, n, 0, n, len(p) // 4)))
                if len(out[0]) >= 1000:
                    yield flush()
        if kind is not None:
            take(packer.finish())
            yield flush()

    return keyed(df, run, id_column, ["text", *[prompt_column] * bool(prompt_column)], {n: "binary" if n == "ids" else "long" for n in names})


def pack_documents(docs: DataFrame) -> DataFrame:
    """The pieces of documents, for the query and the pipeline: word_bpe_49k ids and end id 2, sequences of 4096, every token bears loss."""
    pieces = pack(docs, "word_bpe_49k.json", False, 2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
