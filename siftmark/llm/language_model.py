"""LM scoring: an n-gram trie with Elias-Fano pointers and quantised smoothed probabilities in memory-mapped levels.

Words are the positions of their 64-bit hashes in a sorted vocabulary, kept in files by ranges of hashes. N-grams are dealt by
their first word, those that begin with a frequent word by their first two; each shard is a trie file of its own. A node's
children are the words after its context, in ascending order, between two neighbouring pointers; the search for a longer
n-gram starts at the node of its context, which the shorter n-gram that ends one word before has found.

Smoothing is interpolated absolute discounting: P(w | h) = max(c(hw) - D, 0) / c(h) + D * T(h) / c(h) * P(w | h'), with T the
number of distinct words after h, h' the context without its first word, and D per length from the counts of counts of all
n-grams. Where h is unseen, P(w | h'). Single words have P(w) = (c + 1) / (N + V + 1), which leaves mass for unknown words, so
each context's probabilities sum to one but for rounding. Both factors are kept as one of 4096 steps of their logarithm, the
same steps whatever the data, so a score depends neither on the number of shards nor on how the n-grams are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary_ids import pack
from .common import U64, map_file, mix, packed, partitions, prepare, release, shared_dir, table, word_hashes, write_file

END = U64(0x243F6A8885A308D3)  # the hash of the token after each text
ORDER = 3
MOST_TYPES = 2**32 - 2  # two more ids stand for the space behind a text and for unknown words
STEPS, DEEPEST = 4096, 40.0  # of a logarithm: 12 bits from 1 down to exp(-40)
CODE = 12
STEP = 3 << 20  # bytes of text that are taken at once


def unpacked(window: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    """Integers of `bits` bits at places `at`; window has the 8 bytes from each byte on."""
    if not bits:
        return np.zeros(len(at), np.int64)
    place = at * bits
    return ((window[place >> 3] >> (place & 7).astype(U64)) & U64((1 << bits) - 1)).astype(np.int64)


def windows(data: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit integer that starts at each byte."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def ranked(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The place of the set bit with r set bits before it."""
    place, word, r = np.zeros(len(r), np.int64), word.copy(), r.copy()
    for half in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(word & U64((1 << half) - 1)).astype(np.int64)
        up = r >= low
        r -= low * up
        place += half * up
        word = np.where(up, word >> U64(half), word)
    return place


class Monotone:
    """An Elias-Fano sequence: low bits in fixed width, high parts in unary, with the count of ones before each word of 64."""

    @staticmethod
    def layout(values: np.ndarray) -> list[np.ndarray]:
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (top // max(1, n)).bit_length() - 1)
        high = np.zeros(-(-(n + (top >> low) + 1) // 64) * 64, np.uint8)
        high[(values >> low) + np.arange(n)] = 1
        bits = np.packbits(high, bitorder="little").view("<u8")
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))]).astype("<i8")
        lows = np.concatenate([pack((values & ((1 << low) - 1)).astype(np.uint32), low) if low else np.zeros(0, np.uint8), np.zeros(8, np.uint8)])
        return [np.array([low], "<i8"), bits, before, lows]

    def __init__(self, parts: list[np.ndarray]):
        self.low, self.bits, self.before, self.lows = int(parts[0].view("<i8")[0]), parts[1].view("<u8"), parts[2].view("<i8"), windows(parts[3])

    def at(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, i, "right") - 1
        place = word * 64 + ranked(self.bits[word], i - self.before[word])
        return ((place - i) << self.low) | unpacked(self.lows, self.low, i)

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at i and i + 1, of which the second is mostly the next set bit of the same word."""
        word = np.searchsorted(self.before, i, "right") - 1
        bits = self.bits[word]
        place = ranked(bits, i - self.before[word])
        rest = bits & (U64(0xFFFFFFFFFFFFFFFE) << place.astype(U64))
        lowest = rest & (~rest + U64(1))
        following = word * 64 + np.bitwise_count(lowest - U64(1)).astype(np.int64)
        beyond = np.flatnonzero(rest == 0)
        out = ((word * 64 + place - i) << self.low) | unpacked(self.lows, self.low, i)
        following = ((following - i - 1) << self.low) | unpacked(self.lows, self.low, i + 1)
        following[beyond] = self.at(i[beyond] + 1)
        return out, following


def coded(values: np.ndarray) -> np.ndarray:
    """Values in (0, 1] as packed steps of their logarithm."""
    code = np.rint(-np.log(np.maximum(values, 1e-300)) * ((STEPS - 1) / DEEPEST))
    return packed_bits(np.clip(code, 0, STEPS - 1).astype(np.uint32), CODE)


BOOK = np.exp(-np.arange(STEPS) * (DEEPEST / (STEPS - 1)))


def packed_bits(values: np.ndarray, bits: int) -> np.ndarray:
    """pack() with room behind for windows()."""
    return np.concatenate([pack(values.astype(np.uint32), bits), np.zeros(8, np.uint8)])


def save(uri: str, parts: list[np.ndarray]) -> None:
    """Parts after a table of their sizes; each starts at a multiple of 8 bytes."""
    sizes = [x.nbytes for x in parts]
    body = [y for x, n in zip(parts, sizes, strict=True) for y in (x, np.zeros(-n % 8, np.uint8))]
    write_file(uri, [np.array([len(parts), *sizes], "<i8"), *body])


def load(uri: str) -> list[np.ndarray]:
    data = map_file(uri)
    n = int(data[:8].view("<i8")[0])
    out, at = [], 8 * (n + 1)
    for size in data[8:at].view("<i8"):
        out.append(data[at : at + size])
        at += int(size) + int(-size % 8)
    return out


class Trie:
    """One shard: level 1 has the first words; level k + 1 has the children of level k's nodes, in their order.

    It is written twice: n-grams and counts as they are merged (the structure), then the probabilities, once the counts of
    counts of all shards are known.
    """

    @staticmethod
    def structure(grams: np.ndarray, counts: np.ndarray, nil: int) -> list[np.ndarray]:
        """grams: sorted distinct rows of word ids, `nil` behind the end of a text; counts: how often each starts somewhere."""
        order = grams.shape[1]
        bits = nil.bit_length()
        parts = [np.array([order, bits], "<i8")]
        parent, above = np.zeros(len(grams), np.int64), 1  # of each gram at the level above, and how many nodes that has
        for level in range(1, order + 1):
            real = grams[:, level - 1] != nil
            g, c, up = grams[real], counts[real], parent[real]
            new = np.ones(len(g), bool)
            if len(g):
                new[1:] = (up[1:] != up[:-1]) | (g[1:, level - 1] != g[:-1, level - 1])
            starts = np.flatnonzero(new)
            count = np.add.reduceat(c, starts) if len(starts) else np.zeros(0, np.int64)
            word = g[starts, level - 1]
            if level > 1:
                parts += Monotone.layout(np.concatenate([[0], np.cumsum(np.bincount(up[starts], minlength=above))]))
                parts += [packed_bits(word, bits)]
            else:
                parts += [word.astype("<u4")]
            large = np.flatnonzero(count > 254)
            parts += [np.minimum(count, 255).astype(np.uint8), large.astype("<i8"), count[large].astype("<i8")]
            grams, counts, parent, above = g, c, np.cumsum(new) - 1, len(starts)
        return parts

    def __init__(self, parts: list[np.ndarray], values: list[np.ndarray] | None = None):
        self.order, self.bits = (int(x) for x in parts[0].view("<i8"))
        self.first = parts[1].view("<u4")
        self.counted = [parts[2:5]]
        self.pointers, self.words = [], []
        for k in range(self.order - 1):
            p = parts[5 + 8 * k : 13 + 8 * k]
            self.pointers.append(Monotone(p[:4]))
            self.words.append(windows(p[4]))
            self.counted.append(p[5:8])
        self.share = [windows(x) for x in values[0::2]] if values else []
        self.left = [windows(x) for x in values[1::2]] if values else []

    def counts(self, level: int) -> np.ndarray:
        """How often each node's n-gram occurs."""
        small, large, value = self.counted[level - 1]
        out = small.astype(np.int64)
        out[large.view("<i8")] = value.view("<i8")
        return out

    def children(self, level: int) -> np.ndarray:
        n = len(self.counted[level - 1][0])
        ends = self.pointers[level - 1].at(np.arange(n + 1)) if n else np.zeros(1, np.int64)
        return np.diff(ends)

    def probabilities(self, cuts: list[float], hot: np.ndarray, hot_counts: np.ndarray) -> list[np.ndarray]:
        """Per level from the second: each node's discounted share, and the mass that its context leaves; cuts: D by length.

        The counts of frequent first words, whose n-grams lie in several shards, are given; they leave what the model says.
        """
        out = []
        for level in range(2, self.order + 1):
            kinds, count = self.children(level - 1), self.counts(level)
            above = np.repeat(np.arange(len(kinds)), kinds)
            inside = np.bincount(above, count, len(kinds))
            if level == 2 and len(hot):
                at = np.minimum(np.searchsorted(hot, self.first), len(hot) - 1)
                inside = np.where(hot[at] == self.first, hot_counts[at], inside)
            inside = np.maximum(inside, 1)
            cut = cuts[level - 2]
            out += [coded((count - cut) / inside[above]), coded(np.maximum(cut * kinds / inside, 1e-12))]
        return out

    def roots(self, words: np.ndarray) -> np.ndarray:
        """The nodes of single words, -1 where there is none."""
        if not len(self.first):
            return np.full(len(words), -1, np.int64)
        node = np.minimum(np.searchsorted(self.first, words), len(self.first) - 1)
        return np.where(self.first[node] == words, node, -1)

    def step(self, level: int, node: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """From nodes of a level to their children of the wanted words: the child or -1, its share (0 if unseen), the mass left to shorter contexts, and whether the node has children."""
        pointers, words = self.pointers[level - 1], self.words[level - 1]
        low, end = pointers.pair(node)
        seen = low < end
        left = BOOK[unpacked(self.left[level - 1], CODE, node)]
        high = end.copy()
        open_ = np.flatnonzero(seen)
        while len(open_):  # the first child that is not less than the wanted word
            mid = (low[open_] + high[open_]) >> 1
            less = unpacked(words, self.bits, mid) < wanted[open_]
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
            open_ = open_[low[open_] < high[open_]]
        child = np.full(len(node), -1, np.int64)
        at = np.flatnonzero(low < end)
        at = at[unpacked(words, self.bits, low[at]) == wanted[at]]
        child[at] = low[at]
        share = np.zeros(len(node))
        share[at] = BOOK[unpacked(self.share[level - 1], CODE, low[at])]
        return child, share, left, seen


class Vocabulary:
    """Word hashes in ascending order over files by hash range; a word's id is its place in all of them."""

    def __init__(self, folder: str, sizes: list[int]):
        self.folder, self.n = folder, len(sizes)
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.files: dict[int, list[np.ndarray]] = {}

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1 if unknown) and counts of sorted hashes."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        shard = (h >> U64(32)) * U64(self.n) >> U64(32)
        cuts = np.searchsorted(shard, np.arange(self.n + 1, dtype=U64))
        for s in range(self.n):
            a, z = cuts[s], cuts[s + 1]
            if a == z or self.first[s] == self.first[s + 1]:
                continue
            if s not in self.files:
                self.files[s] = [x.view(t) for x, t in zip(load(f"{self.folder}/{s:06d}.words"), ("<u8", "<i8"), strict=True)]
            known, n = self.files[s]
            at = np.minimum(np.searchsorted(known, h[a:z]), len(known) - 1)
            ok = known[at] == h[a:z]
            ids[a:z][ok] = self.first[s] + at[ok]
            counts[a:z][ok] = n[at[ok]]
        return ids, counts


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def rows_summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows of ids below 2**32 and the sums of their counts."""
    key = (grams[:, 0].astype(U64) << U64(32)) | grams[:, 1].astype(U64)
    order = np.lexsort((*grams.T[:1:-1], key)) if grams.shape[1] > 2 else np.argsort(key, kind="stable")
    grams, counts = grams[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]).any(1)])) if len(grams) else np.zeros(0, np.int64)
    return grams[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def count_words(texts: DataFrame, folder: str, n: int) -> DataFrame:
    """Write the vocabulary of all texts; (shard, types, tokens) per file. Each task sums its words before they are sent."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes]]]:
        for b in batches:
            for raws in steps(b.column(0)):
                h, c = np.unique(np.append(word_hashes(raws)[0], np.full(len(raws), END)), return_counts=True)
                shard = ((h >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)
                cuts = np.searchsorted(shard, np.arange(n + 1))
                yield [(s, h[a:z].tobytes() + c[a:z].tobytes()) for s, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < z]

    def merge(shard: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([np.frombuffer(x, U64, len(x) // 16) for x in blobs])
        h, c = summed(h, np.concatenate([np.frombuffer(x, np.int64, len(x) // 16, len(x) // 2) for x in blobs]))
        save(f"{folder}/{shard:06d}.words", [h, c])
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "types": [len(h)], "tokens": [int(c.sum())]})

    return packed(texts, n, emit, merge, "shard int, types long, tokens long")


def sequences(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens, each text's words and its end, as places among the sorted distinct hashes; these hashes; and the texts' lengths."""
    words, n = word_hashes(raws)
    h = np.full(len(words) + len(raws), END)
    h[np.arange(len(words)) + np.repeat(np.arange(len(raws)), n)] = words
    own, at = np.unique(h, return_inverse=True)
    return at, own, n + 1


def steps(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a column in turns of bounded size; null is empty."""
    size = np.cumsum(pa.compute.binary_length(column.cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False) + 16)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + STEP)))
        yield [x or b"" for x in column.slice(at, end - at).cast(pa.binary()).to_pylist()]
        at = end


def dealt(first: np.ndarray, second: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    """The shard of n-grams by their first word, or if that is a frequent one, by their first two."""
    h = mix(first.astype(U64))
    if len(hot):
        on = hot[np.minimum(np.searchsorted(hot, first), len(hot) - 1)] == first
        h[on] = mix(h[on] + second[on].astype(U64) * U64(0x9E3779B97F4A7C15))
    return (h % U64(n)).astype(np.int64)


def frequent(vocabulary: Vocabulary, spark: SparkSession, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of the words that are more than a quarter of a shard's tokens, fewer than four a shard; and of the start mark."""
    n, folder, first = vocabulary.n, vocabulary.folder, vocabulary.first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column(0).to_pylist():
                h, counts = (x.view(t) for x, t in zip(load(f"{folder}/{s:06d}.words"), ("<u8", "<i8"), strict=True))
                at = np.flatnonzero(counts * 4 * n > tokens)
                end = np.flatnonzero(h == END)  # as often as texts begin
                yield pa.RecordBatch.from_arrays([pa.array(np.append(first[s] + at, np.full(len(end), first[-1]))), pa.array(np.append(counts[at], counts[end]))], ["id", "n"])

    used = [s for s in range(n) if first[s] < first[s + 1]]
    if not used:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = spark.createDataFrame([(s,) for s in used], "shard int").mapInArrow(run, "id long, n long").orderBy("id").collect()
    return np.array([r["id"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)


def count_grams(texts: DataFrame, vocabulary: Vocabulary, hot: np.ndarray, folder: str, order: int, n: int) -> DataFrame:
    """Write a trie's structure per shard. Each n-gram is counted where it starts; a start mark comes before each text.

    Rows: kind 0 has a length, and how many n-grams of it occur once and twice; kind 1 a frequent word, and how many distinct words follow it.
    """
    start = int(vocabulary.first[-1])
    nil = start + 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes]]]:
        for b in batches:
            for raws in steps(b.column(0)):
                at, h, lengths = sequences(raws)
                names = np.concatenate([vocabulary.find(h)[0], [start, nil]])
                first = np.cumsum(lengths) - lengths
                flat = np.full(len(at) + len(lengths) * order, len(h) + 1, np.int64)  # a start mark before, order - 1 times nil behind each text
                text = np.repeat(np.arange(len(lengths)), lengths)
                flat[np.arange(len(at)) + text * order + 1] = at
                flat[first + np.arange(len(lengths)) * order] = len(h)
                begin = np.flatnonzero(flat <= len(h))
                begin = begin[flat[begin + 1] <= len(h)]
                bits = (len(h) + 2).bit_length()
                if order * bits <= 64:  # places in one integer sort as the rows of ids do
                    key = flat[begin].astype(U64)
                    for k in range(1, order):
                        key = (key << U64(bits)) | flat[begin + k].astype(U64)
                    key.sort()
                    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    counts, key = np.diff(np.append(new, len(key))), key[new]
                    grams = np.stack([names[((key >> U64(bits * (order - 1 - k))) & U64((1 << bits) - 1)).astype(np.int64)] for k in range(order)], 1)
                else:
                    grams, counts = rows_summed(np.stack([names[flat[begin + k]] for k in range(order)], 1), np.ones(len(begin), np.int64))
                shard = dealt(grams[:, 0], grams[:, 1], hot, n)
                rank = np.argsort(shard.astype(np.uint16) if n < 1 << 16 else shard, kind="stable")
                cuts = np.searchsorted(shard[rank], np.arange(n + 1))
                out = []
                for s, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if a < z:
                        g = grams[rank[a:z]].astype("<u4")
                        g[1:, 0] -= g[:-1, 0].copy()  # small steps, which the shuffle's compression shortens
                        out.append((s, np.ascontiguousarray(g.T).tobytes() + counts[rank[a:z]].astype("<u4").tobytes()))
                yield out

    def merge(shard: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        gs, cs = [], []
        for x in blobs:
            m = np.frombuffer(x, "<u4").reshape(order + 1, -1).copy()
            m[0] = np.cumsum(m[0], dtype=np.uint32)
            gs.append(m[:order].T)
            cs.append(m[order])
        grams, counts = rows_summed(np.concatenate(gs), np.concatenate(cs).astype(np.int64))
        parts = Trie.structure(grams, counts, nil)
        save(f"{folder}/{shard:06d}.trie", parts)
        trie = Trie(parts)
        rows = [(0, k, int((trie.counts(k) == 1).sum()), int((trie.counts(k) == 2).sum())) for k in range(2, order + 1)]
        kinds = trie.children(1)
        rows += [(1, int(w), int(kinds[i]), 0) for i, w in enumerate(trie.first.tolist()) if w in wanted]
        yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int32()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(4))], ["shard", "kind", "a", "b", "c"])

    wanted = frozenset(hot.tolist())
    return packed(texts, n, emit, merge, "shard int, kind long, a long, b long, c long")


class Model:
    """What a scoring task needs: where the files are, and a few totals."""

    def __init__(self, folder: str, vocabulary: Vocabulary, shards: list[int], n: int, order: int, tokens: int, hot: np.ndarray, hot_left: np.ndarray):
        self.folder, self.vocabulary, self.shards, self.n, self.order, self.tokens = folder, vocabulary, set(shards), n, order, tokens
        self.hot, self.hot_left = hot, hot_left
        self.types = int(vocabulary.first[-1])
        self.tries: dict[int, Trie] = {}

    def trie(self, shard: int) -> Trie:
        if shard not in self.tries:
            self.tries[shard] = Trie(load(f"{self.folder}/trie/{shard:06d}.trie"), load(f"{self.folder}/trie/{shard:06d}.prob"))
        return self.tries[shard]

    def step(self, level: int, shard: np.ndarray, node: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Trie.step in all shards; at level 1 a node is given by its word."""
        child, share, left, seen = np.full(len(node), -1, np.int64), np.zeros(len(node)), np.ones(len(node)), np.zeros(len(node), bool)
        rank = np.argsort(shard.astype(np.uint16) if self.n < 1 << 16 else shard, kind="stable")
        cuts = np.searchsorted(shard[rank], np.arange(self.n + 1))
        for s in self.shards:
            mine = rank[cuts[s] : cuts[s + 1]]
            if len(mine):
                here, t = node[mine], self.trie(s)
                if level == 1:
                    here = t.roots(here)
                    mine, here = mine[here >= 0], here[here >= 0]
                child[mine], share[mine], left[mine], seen[mine] = t.step(level, here, wanted[mine])
        return child, share, left, seen

    def score(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens, known tokens, base score, score."""
        if not raws:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        at, h, lengths = sequences(raws)
        own, counts = self.vocabulary.find(h)
        begin = np.cumsum(lengths + 1) - lengths - 1  # a start mark before each text
        token = np.ones(len(at) + len(lengths), bool)
        token[begin] = False
        flat = np.full(len(token), len(h), np.int64)
        flat[token] = at
        ids = np.append(own, self.types)
        place = np.arange(len(flat)) - np.repeat(begin, lengths + 1)
        unit = np.append((counts + 1) / (self.tokens + self.types + 1), 1.0)
        p = unit[flat]
        here = np.flatnonzero(token)
        here = here[ids[flat[here - 1]] >= 0]
        pair, back = np.unique(flat[here - 1] * (len(h) + 1) + flat[here], return_inverse=True)  # each distinct pair is looked up once
        first, second = ids[pair // (len(h) + 1)], ids[pair % (len(h) + 1)]
        second = np.where(second < 0, self.types + 1, second)  # a word that no context has
        shard = dealt(first, second, self.hot, self.n)
        child, share, left, seen = self.step(1, shard, first, second)
        if len(self.hot):
            k = np.minimum(np.searchsorted(self.hot, first), len(self.hot) - 1)
            on = self.hot[k] == first
            left[on], seen[on] = self.hot_left[k[on]], True
        p[here] = np.where(seen[back], share[back] + left[back] * p[here], p[here])
        node, shards = np.full(len(flat), -1, np.int64), np.zeros(len(flat), np.int64)
        node[here], shards[here] = child[back], shard[back]
        for k in range(3, self.order + 1):
            here = np.flatnonzero(token & (place >= k - 1))
            here = here[node[here - 1] >= 0]
            wanted = ids[flat[here]]
            child, share, left, seen = self.step(k - 1, shards[here - k + 2], node[here - 1], np.where(wanted < 0, self.types + 1, wanted))
            p[here] = np.where(seen, share + left * p[here], p[here])
            node = np.full(len(flat), -1, np.int64)
            node[here] = child
        total = lambda x: np.add.reduceat(x, begin)
        known = np.append(counts > 0, False)[flat]
        return lengths, total(known.astype(np.int64)), total(np.log10(unit)[flat]), total(np.log10(p))


def write_probabilities(spark: SparkSession, folder: str, shards: list[int], cuts: list[float], hot: np.ndarray, hot_counts: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column(0).to_pylist():
                save(f"{folder}/{s:06d}.prob", Trie(load(f"{folder}/{s:06d}.trie")).probabilities(cuts, hot, hot_counts))
            yield b
        release()

    return spark.createDataFrame([(s,) for s in shards], "shard int").repartition(max(1, len(shards))).mapInArrow(run, "shard int")


def train(texts: DataFrame, folder: str, order: int = ORDER) -> Model:
    """A model of all rows of one text column, in files under the folder.

    The driver gets a row per file, the totals of each length, and the frequent words, fewer than four a file. Repeated rows
    count as often as they occur; an empty table gives a model of no words, for which every token is unknown.
    """
    spark = texts.sparkSession
    prepare(spark)
    n = partitions(spark)
    count_words(texts, f"{folder}/words", n).write.parquet(f"{folder}/word-files")
    files = {r["shard"]: r for r in spark.read.parquet(f"{folder}/word-files").collect()}
    vocabulary = Vocabulary(f"{folder}/words", [files[s]["types"] if s in files else 0 for s in range(n)])
    if vocabulary.first[-1] > MOST_TYPES:
        raise ValueError(f"{vocabulary.first[-1]} distinct words are more than the {MOST_TYPES} that ids of 32 bits can name")
    tokens = sum(r["tokens"] for r in files.values())
    hot, hot_counts = frequent(vocabulary, spark, tokens)
    count_grams(texts, vocabulary, hot, f"{folder}/trie", order, n).write.parquet(f"{folder}/trie-files")
    told = spark.read.parquet(f"{folder}/trie-files")
    shards = [r["shard"] for r in told.select("shard").distinct().orderBy("shard").collect()]
    totals = {(r["kind"], r["a"]): (r["b"], r["c"]) for r in told.groupBy("kind", "a").agg(F.sum("b").alias("b"), F.sum("c").alias("c")).collect()}
    seen = [totals.get((0, k), (0, 0)) for k in range(2, order + 1)]
    cuts = [once / (once + 2 * twice) if once and twice else 0.5 for once, twice in seen]
    kinds = np.array([totals.get((1, int(w)), (0, 0))[0] for w in hot], np.int64)
    left = np.maximum(cuts[0] * kinds / np.maximum(hot_counts, 1), 1e-12)
    hot_left = BOOK[unpacked(windows(coded(left)), CODE, np.arange(len(left)))] if len(left) else left
    if shards:
        write_probabilities(spark, f"{folder}/trie", shards, cuts, hot, hot_counts).write.parquet(f"{folder}/probability-files")
    return Model(folder, vocabulary, shards, n, order, tokens, hot, hot_left)


def score(df: DataFrame, model: Model, id_column: str = "doc_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, extra columns, n_tokens, n_known, base_score, score) of each row's text; null text is empty: just its end.

    Equal texts have equal scores. Texts are taken whole, however long; other columns are not read.
    """
    prepare(df.sparkSession)
    kept = [id_column, *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for raws in steps(b.column(0)):
                some, at = b.slice(at, len(raws)), at + len(raws)
                arrays = [pa.array(x, t) for x, t in zip(model.score(raws), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns[1:], *arrays], [*kept, "n_tokens", "n_known", "base_score", "score"])
        release()

    kinds = dict(df.dtypes)
    return df.select("text", *kept).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", n_tokens long, n_known long, base_score double, score double")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of six sevenths of them. A null id counts as an empty id text, so its document is trained on."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 7 == 2)
    model = train(docs.where("NOT held_out").select("text"), shared_dir(spark, "language-model"))
    return score(docs, model, extra=("held_out",)).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
