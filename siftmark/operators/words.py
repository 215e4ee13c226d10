"""Which of very many words stand in a text: a table of the words' bytes that a whole batch of texts asks at once, sent or in files.

Every place of a text gives eight bytes as one number. A word of up to eight bytes stands there if the number, cut to its
length, is the word; a longer word is found by the eight of its bytes that fewest words have, and then compared. So the work
grows with the texts, not with the words. A library is sent to all tasks only up to a size; a larger one is made
to files by the tasks, which are mapped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..sources.shared import map_file, shared_dir, write_file

U64 = np.uint64
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
SPREAD = U64(0x9E3779B97F4A7C15)
ODD, BASE = U64(0xD6E8FEB86659FD93), U64(0x5851F42D4C957F2D)
LONG, FIRST = 9, 10  # kinds of numbers: of words over eight bytes, and of their first eight; up to eight, it is the length
MOST_BYTES = 4 << 20  # of words that the driver sends to all tasks; as Python objects they take many times as much
SHARD = 2 << 20  # bytes of words in a file, about
STEP = 1 << 20  # bytes of texts looked through at once


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))


class Words:
    """Distinct words, of which find() tells those that texts hold."""

    def __init__(self, words: list[str]):
        self.words = sorted(set(words) - {""})
        raws = [w.encode() for w in self.words]
        self.size = np.fromiter(map(len, raws), np.int64, len(raws))
        self.data = np.frombuffer(b"".join([*raws, b"\xff" * 8]), np.uint8)
        self.start = np.cumsum(self.size) - self.size
        whole = eights(self.data)
        key, self.lead = np.zeros(len(raws), U64), np.zeros(len(raws), np.int64)  # lead: where in a word its key begins
        kind = np.minimum(self.size, 8)
        short = np.flatnonzero(self.size <= 8)
        key[short] = whole[self.start[short]] & MASKS[self.size[short]]
        long = np.flatnonzero(self.size > 8)
        if len(long):
            count = self.size[long] - 7
            first = np.cumsum(count) - count
            inside = np.arange(int(count.sum())) - np.repeat(first, count)
            windows = whole[np.repeat(self.start[long], count) + inside]
            _, back, times = np.unique(windows, return_inverse=True, return_counts=True)
            rank = times[back] * (int(count.max()) + 1) + inside  # the rarest, and of these the first
            self.lead[long] = np.minimum.reduceat(rank, first) % (int(count.max()) + 1)
            key[long] = whole[self.start[long] + self.lead[long]]
        self.tables = []
        for k in np.unique(kind).tolist():
            mine = np.flatnonzero(kind == k)
            mine = mine[np.argsort(key[mine], kind="stable")]
            keys, begin = np.unique(key[mine], return_index=True)
            bits = max(12, (16 * len(keys)).bit_length())
            seen = np.zeros(1 << bits, bool)
            seen[self.place(keys, bits)] = True
            self.tables.append((k, keys, np.append(begin, len(mine)), mine, seen, bits))

    @staticmethod
    def place(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys ^ (keys >> U64(29))) * SPREAD) >> U64(64 - bits)

    def equal(self, word: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each word stands at its place, beyond the eight bytes of its key."""
        ok = (at >= 0) & (at + self.size[word] <= len(data) - 8)
        live, k = np.flatnonzero(ok), 0
        mine, given = eights(self.data), eights(data)
        while len(live):
            left = self.size[word[live]] - k
            same = (mine[self.start[word[live]] + k] ^ given[at[live] + k]) & MASKS[np.minimum(left, 8)] == 0
            ok[live[~same]] = False
            live, k = live[same & (left > 8)], k + 8
        return ok

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (text, word), each once, by text and then word; 0xFF, which no word has, parts the texts."""
        data = np.frombuffer(b"".join(x for t in texts for x in (t, b"\xff" * 8)), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 8)
        whole = eights(data)
        found = []
        for k, keys, begin, mine, seen, bits in self.tables:
            cut = whole & MASKS[k] if k < 8 else whole
            at = np.flatnonzero(seen[self.place(cut, bits)])
            row = np.minimum(np.searchsorted(keys, cut[at]), len(keys) - 1)
            hit = keys[row] == cut[at]
            at, row = at[hit], row[hit]
            n = begin[row + 1] - begin[row]
            word = mine[np.repeat(begin[row] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            at = np.repeat(at, n)
            if k == 8:
                ok = self.equal(word, data, at - self.lead[word])
                at, word = at[ok], word[ok]
            found.append(np.unique(np.searchsorted(ends, at, "right") * len(self.words) + word))
        both = np.concatenate(found) if found else np.zeros(0, np.int64)
        both.sort()
        return both // max(1, len(self.words)), both % max(1, len(self.words))


class Groups:
    """Lists of words with the fewest that a text must hold; a word that is twice in a list counts twice."""

    def __init__(self, words: Words, lists: list[tuple[list[str], int]]):
        index = {w: i for i, w in enumerate(words.words)}
        pairs = [(index[w], g) for g, (ws, _) in enumerate(lists) for w in ws if w in index]
        by = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.group, self.begin = by[:, 1], np.searchsorted(by[:, 0], np.arange(len(index) + 1))
        self.least = np.array([max(1, n) for _, n in lists], np.int64)

    def find(self, which: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (text, group) of what Words.find() gave, by text and then group."""
        n = self.begin[word + 1] - self.begin[word]
        group = self.group[np.repeat(self.begin[word] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        both, times = np.unique(np.repeat(which, n) * max(1, len(self.least)) + group, return_counts=True)
        which, group = both // max(1, len(self.least)), both % max(1, len(self.least))
        ok = times >= self.least[group]
        return which[ok], group[ok]


def sent(texts: DataFrame, words: list[str], text: str, held: str, lists: list[tuple[list[str], int]] = (), hit: str = "hit") -> DataFrame:
    """texts with the words that each holds and, if lists are given, the numbers of the lists of which it holds enough."""
    spark = texts.sparkSession
    known = Words(words)
    table = spark.sparkContext.broadcast((known, Groups(known, list(lists))))
    names = [f"_{i}" for i in range(len(texts.columns))]
    place = texts.columns.index(text)
    added = [held, hit] if lists else [held]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, groups = table.value
        listed = pa.array(mine.words, pa.string())
        for b in batches:
            raws = [x or b"" for x in b.column(place).cast(pa.binary()).to_pylist()]
            at = 0
            while at < len(raws):
                end, size = at, 0
                while end < len(raws) and (end == at or size + len(raws[end]) <= STEP):
                    size, end = size + len(raws[end]), end + 1
                which, word = mine.find(raws[at:end])
                cuts = lambda which: pa.array(np.searchsorted(which, np.arange(end - at + 1)).astype(np.int32))  # noqa: E731, B023
                more = [pa.ListArray.from_arrays(cuts(which), listed.take(pa.array(word)))]
                if lists:
                    which, group = groups.find(which, word)
                    more.append(pa.ListArray.from_arrays(cuts(which), pa.array(group.astype(np.int32))))
                some = b.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*some.columns, *more], [*names, *added])
                at = end

    kinds = [ArrayType(StringType()), ArrayType(IntegerType())]
    schema = StructType([*(StructField(n, f.dataType, f.nullable) for n, f in zip(names, texts.schema, strict=True)), *(StructField(n, k) for n, k in zip(added, kinds))])
    return texts.toDF(*names).mapInArrow(run, schema).toDF(*texts.columns, *added)


def mixed(key: np.ndarray, kind: int) -> np.ndarray:
    """One number of a key and its kind; keys of one kind never meet."""
    h = key ^ (SPREAD * U64(2 * kind + 1))
    h = (h ^ (h >> U64(32))) * ODD
    h = (h ^ (h >> U64(32))) * ODD
    return h ^ (h >> U64(32))


def sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the bytes, each times its power, before each place; and what brings a difference of two back to place 0."""
    power = np.full(len(data), BASE, U64)
    power[:1] = 1
    back = np.full(len(data) + 1, pow(int(BASE), -1, 1 << 64), U64)
    back[0] = 1
    with np.errstate(over="ignore"):
        before = np.zeros(len(data) + 1, U64)
        np.cumsum(data.astype(U64) * np.multiply.accumulate(power), out=before[1:])
        return before, np.multiply.accumulate(back)


def joined(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all, parted by 0xFF, which no word has, and where each begins."""
    data = np.frombuffer(b"".join(x for r in raws for x in (r, b"\xff" * 8)), np.uint8)
    size = np.fromiter(map(len, raws), np.int64, len(raws)) + 8
    return data, np.cumsum(size) - size


class Shelf:
    """The words of files that write() made, of which find() tells those that texts hold.

    A word's number is made of its bytes; its first bits name the file it lies in, memory-mapped. A long word is asked for where
    its first eight bytes stand, once for each length that words with these have. A few bits a word, held in memory, tell most
    numbers that no word has.
    """

    def __init__(self, folder: str, shards: int, bits: int):
        self.shift, self.bits = 64 - (shards.bit_length() - 1), bits
        self.parts = []
        seen = []
        for s in range(shards):
            raw = map_file(f"{folder}/{s:06d}.words")
            n, m, size, full = raw[:32].view(np.int64).tolist()
            cuts = np.cumsum([32, 8 * n, 8 * (n + 1), 8 * m, 8 * m, full]).tolist()
            of = [raw[x:y] for x, y in zip(cuts, [*cuts[1:], cuts[-1] + size], strict=True)]
            self.parts.append((of[0].view(U64), of[1].view(np.int64), of[2].view(U64), of[3].view(np.int64), of[5]))
            seen.append(of[4])
        self.seen = np.concatenate(seen)

    @staticmethod
    def write(words: DataFrame, folder: str, shards: int, bits: int) -> None:
        """words: distinct, not empty, in the column `word`."""
        top, part = U64(64 - (shards.bit_length() - 1)), bits - (shards.bit_length() - 1)

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                raws = b.column(0).cast(pa.binary()).to_pylist()
                data, start = joined(raws)
                size = np.fromiter(map(len, raws), np.int64, len(raws))
                before, back = sums(data)
                whole = eights(data)[start]
                own = np.where(size > 8, mixed((before[start + size] - before[start]) * back[start], LONG), U64(0))
                for k in range(1, 9):
                    own[size == k] = mixed(whole[size == k] & MASKS[k], k)
                long = np.flatnonzero(size > 8)
                ahead, length = np.unique(np.stack([mixed(whole[long], FIRST), size[long].astype(U64)]), axis=1)
                both = np.concatenate([own, ahead])
                word = pa.array([*raws, *[None] * len(ahead)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array((both >> top).astype(np.int32)), pa.array(both.view(np.int64)), pa.array(np.concatenate([size, length.astype(np.int64)])), word], ["shard", "number", "size", "word"])

        def file(shard: int, rows: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> None:
            own, size = (np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int64) for i in (0, 1))
            word = pa.concat_arrays([r[2] for r in rows]) if rows else pa.array([], pa.binary())
            own, named = own.view(U64), np.asarray(word.is_valid())
            order = np.flatnonzero(named)[np.argsort(own[named], kind="stable")]
            ahead, length = np.unique(np.stack([own[~named], size[~named].astype(U64)]), axis=1)
            at = (np.concatenate([own, ahead]) >> U64(64 - bits)) & U64((1 << part) - 1)
            seen = np.zeros(1 << part, bool)
            seen[at.astype(np.int64)] = True
            packed = np.packbits(seen, bitorder="little")
            ends = np.concatenate([[0], np.cumsum(size[order])])
            data = b"".join([*word.take(pa.array(order)).to_pylist(), b"\xff" * 8])
            head = np.array([len(order), len(ahead), len(data), len(packed)], np.int64)
            write_file(f"{folder}/{shard:06d}.words", [head, own[order], ends.astype(np.int64), ahead, length.astype(np.int64), packed, data])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, rows, made = None, [], []
            for b in batches:
                shard = b.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
                for x, y in zip(cuts, cuts[1:]):
                    if x == y:
                        continue
                    if rows and int(shard[x]) != at:
                        file(at, rows)
                        made.append(at)
                        rows = []
                    at = int(shard[x])
                    rows.append((*(b.column(i).slice(x, y - x).to_numpy().copy() for i in (1, 2)), b.column(3).slice(x, y - x)))
            if rows:
                file(at, rows)
                made.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.int32())], ["shard"])

        spark = words.sparkSession
        rows = words.select("word").mapInArrow(number, "shard int, number long, size long, word binary")
        n = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
        made = {r[0] for r in rows.repartitionById(n, F.col("shard") % n).sortWithinPartitions("shard").mapInArrow(run, "shard int").collect()}
        for s in set(range(shards)) - made:
            file(s, [])

    def may(self, number: np.ndarray) -> np.ndarray:
        at = number >> U64(64 - self.bits)
        return (self.seen[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & 1 != 0

    def split(self, number: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(file, from, to) of sorted numbers."""
        ends = np.searchsorted(number >> U64(self.shift), np.arange(len(self.parts) + 1).astype(U64))
        return ((s, a, b) for s, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist(), strict=False)) if a < b)

    @staticmethod
    def rows(keys: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the sorted numbers, row of keys) where they are equal."""
        own, back = np.unique(number, return_inverse=True)
        begin, end = np.searchsorted(keys, own, "left")[back], np.searchsorted(keys, own, "right")[back]
        n = end - begin
        return np.repeat(np.arange(len(number)), n), np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
        """Pairs (text, word), each once, by text."""
        data, start = joined(texts)
        whole = eights(data)
        maybe = []
        for k in range(1, 9):
            number = mixed(whole & MASKS[k], k)
            at = np.flatnonzero(self.may(number))
            maybe.append((number[at], at, np.full(len(at), k)))
        number = mixed(whole, FIRST)
        at = np.flatnonzero(self.may(number))
        at = at[np.argsort(number[at], kind="stable")]
        before, back = sums(data)
        for s, x, y in self.split(number[at]):
            which, row = self.rows(self.parts[s][2], number[at[x:y]])
            place, size = at[x:y][which], self.parts[s][3][row]
            ok = place + size <= len(data) - 8
            place, size = place[ok], size[ok]
            own = mixed((before[place + size] - before[place]) * back[place], LONG)
            ok = self.may(own)
            maybe.append((own[ok], place[ok], size[ok]))
        number, at, size = (np.concatenate([m[i] for m in maybe]) for i in range(3))
        order = np.argsort(number, kind="stable")
        number, at, size = number[order], at[order], size[order]
        texts_of, words = [], []
        for s, x, y in self.split(number):
            keys, ends, _, _, raw = self.parts[s]
            which, row = self.rows(keys, number[x:y])
            place, long = at[x:y][which], size[x:y][which]
            ok = ends[row + 1] - ends[row] == long
            live, k, mine = np.flatnonzero(ok & (long > 8)), 0, eights(raw)
            while len(live):  # shorter ones are their keys
                left = long[live] - k
                same = (mine[ends[row[live]] + k] ^ whole[place[live] + k]) & MASKS[np.minimum(left, 8)] == 0
                ok[live[~same]] = False
                live, k = live[same & (left > 8)], k + 8
            both = np.unique((np.searchsorted(start, place[ok], "right") - 1) * len(keys) + row[ok])
            texts_of.append(both // len(keys))
            row = both % len(keys)
            lengths = ends[row + 1] - ends[row]
            cuts = np.concatenate([[0], np.cumsum(lengths)])
            some = raw[np.repeat(ends[row] - cuts[:-1], lengths) + np.arange(int(cuts[-1]))]
            words.append(pa.StringArray.from_buffers(len(row), pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(some)))
        if not words:
            return np.zeros(0, np.int64), pa.array([], pa.string())
        which = np.concatenate(texts_of)
        order = np.argsort(which, kind="stable")
        return which[order], pa.concat_arrays(words).take(pa.array(order))


def filed(texts: DataFrame, words: DataFrame, count: int, size: int, text: str, held: str) -> DataFrame:
    """texts with the words that each holds, in order. words: distinct, not empty; count and size: how many they are, and bytes."""
    spark = texts.sparkSession
    folder = shared_dir(spark, "words")
    shards = 1 << max(2, (size // SHARD).bit_length())
    bits = max(shards.bit_length() + 2, (8 * count).bit_length())
    Shelf.write(words, folder, shards, bits)
    names = [f"_{i}" for i in range(len(texts.columns))]
    place = texts.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = Shelf(folder, shards, bits)
        for b in batches:
            lengths = pc.fill_null(pc.binary_length(b.column(place)), 0).to_numpy(zero_copy_only=False)
            at = 0
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(np.cumsum(lengths[at:]), STEP, "right")) + at)
                some = b.slice(at, end - at)
                which, word = shelf.find([x or b"" for x in some.column(place).cast(pa.binary()).to_pylist()])
                cuts = pa.array(np.searchsorted(which, np.arange(some.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.ListArray.from_arrays(cuts, word)], [*names, held])
                at = end

    schema = StructType([*(StructField(n, f.dataType, f.nullable) for n, f in zip(names, texts.schema, strict=True)), StructField(held, ArrayType(StringType()))])
    return texts.toDF(*names).mapInArrow(run, schema).toDF(*texts.columns, held).withColumn(held, F.array_sort(held))


def with_words(texts: DataFrame, words: DataFrame, key: str, text: str = "text", held: str = "held", most: int = MOST_BYTES) -> DataFrame:
    """texts with an array of the words (column `word`) that each holds, as contains() finds them; none in a null text.

    Up to `most` bytes of words, by a table that goes to all tasks. Beyond, by files that tasks make of the words' parts and all
    map; no words come to the driver. Either way in one pass over the texts. Empty and null words are left out.
    """
    from .match import materialise

    distinct = materialise(words.where(F.length("word") > 0).select("word").distinct())
    size, count = distinct.agg(F.coalesce(F.sum(F.octet_length("word").cast("long")), F.lit(0)), F.count("*")).first()
    if size <= most:
        return sent(texts, [r[0] for r in distinct.collect()], text, held)
    return filed(texts, distinct, count, size, text, held)
