"""Encoding with public BPE tokenizers, one chunk of text at a time, each distinct chunk once."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from .common import MASKS, SHORT, U64, eights, span_hashes

#: Where the libraries' white-space classes may differ, or control characters join words: such texts are encoded whole.
ODD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0 ᠎ -‏    　﻿]")
#: A cut before white space that follows other characters never parts a token of these tokenizers.
CHUNK = re.compile(r"\s*\S+|\s+")
CUT = re.compile(r"(?<=\S)\s")
#: In texts of these characters only, neither does one between a letter and another character: no apostrophes, marks or other
#: letters. They are single bytes of Latin-1, so that numpy can cut whole batches.
PLAIN = re.compile(r"[^\t\n\x20-&(-~¡-©«-´¶-¹»-ÿ]")
#: Class of a Latin-1 byte: 0 for white space, 1 for letters, 2 for others.
CLASS = np.array([0 if c in b"\t\n " else 1 if re.fullmatch("[A-Za-zÀ-ÖØ-öø-ÿ]", chr(c)) else 2 for c in range(256)], np.uint8)
#: Chunks that may be encoded side by side in one text, as no token reaches over the separator, nor makes one with it.
BESIDE = re.compile(r" ?[!-}]+")


@lru_cache(maxsize=4)
def load(name: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))


class Runs:
    """Chunks, their hashes and their ids in flat arrays: a table with linear probing, which whole batches ask at once."""

    def __init__(self, bits: int = 20):
        self.bits = bits
        self.key, self.entry = np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int32)
        self.first, self.size, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.place, self.length, self.raw = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 16, np.uint8)
        self.n = self.used = self.filled = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        at, live = (h >> U64(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(live):
            e = self.entry[at]
            same = (self.key[at] == h[live]) & (e >= 0)
            out[live[same]] = e[same]
            on = (e >= 0) & ~same
            live, at = live[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def same(self, entry: np.ndarray, data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether each entry's chunk is the span of `data`, byte by byte."""
        ok = self.length[entry] == length
        mine, given = eights(self.raw), eights(data)
        live, k = np.flatnonzero(ok & (length <= SHORT)), 0
        while len(live):
            left = length[live] - k
            equal = (mine[self.place[entry[live]] + k] ^ given[starts[live] + k]) & MASKS[np.minimum(left, 8)] == 0
            ok[live[~equal]] = False
            live, k = live[equal & (left > 8)], k + 8
        for i in np.flatnonzero(ok & (length > SHORT)).tolist():
            at = self.place[entry[i]]
            ok[i] = np.array_equal(self.raw[at : at + length[i]], data[starts[i] : starts[i] + length[i]])
        return ok

    def store(self, raws: list[bytes], ids: list[bytes]) -> np.ndarray:
        """Entries for chunks, each with its ids; the table does not lead to them."""
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        length = np.fromiter(map(len, raws), np.int64, len(raws))
        flat, raw = np.frombuffer(b"".join(ids), "<u4"), np.frombuffer(b"".join(raws), np.uint8)
        while self.n + len(ids) > len(self.first):
            self.first, self.size, self.place, self.length = (np.concatenate([x, x]) for x in (self.first, self.size, self.place, self.length))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        while self.filled + len(raw) + 8 > len(self.raw):
            self.raw = np.concatenate([self.raw, self.raw])
        mine = np.arange(self.n, self.n + len(ids), dtype=np.int32)
        self.first[mine], self.size[mine] = self.used + np.cumsum(size) - size, size
        self.place[mine], self.length[mine] = self.filled + np.cumsum(length) - length, length
        self.ids[self.used : self.used + len(flat)], self.raw[self.filled : self.filled + len(raw)] = flat, raw
        self.n, self.used, self.filled = self.n + len(ids), self.used + len(flat), self.filled + len(raw)
        return mine

    def add(self, h: np.ndarray, raws: list[bytes], ids: list[bytes]) -> None:
        """New distinct hashes, each with its chunk and ids."""
        mine = self.store(raws, ids)
        at = (h >> U64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.entry[at] < 0)
            place, one = np.unique(at[free], return_index=True)
            self.key[place], self.entry[place] = h[free[one]], mine[free[one]]
            on = np.ones(len(h), bool)
            on[free[one]] = False
            h, mine, at = h[on], mine[on], (at[on] + 1) & ((1 << self.bits) - 1)

    def flat(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all entries in a row, and how many each has."""
        size = self.size[entries]
        return self.ids[np.repeat(self.first[entries] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))], size


class Chunks:
    """Texts to ids by chunks: Latin-1 texts are cut, hashed and looked up in numpy, and only chunks that are not known reach each().

    kinds gives each byte's class: 0 joins the chunk that follows, or none if not spaced; 3 is a chunk by itself; runs of each
    other class are chunks. The memory of chunks is bounded. They are found by hashes and told apart by their bytes.
    """

    most, step = 400_000, 1 << 17
    kinds, spaced = CLASS, True

    def __init__(self) -> None:
        self.runs = Runs()

    def each(self, chunks: list[str]) -> list[bytes]:
        raise NotImplementedError

    def plain(self, raws: list[bytes]) -> list[bytes]:
        """Ids of Latin-1 texts."""
        padded = np.frombuffer(b"".join([*raws, b"\n" * 8]), np.uint8)
        data = padded[:-8]
        length = np.fromiter(map(len, raws), np.int64, len(raws))
        begin = np.cumsum(length) - length
        kind = self.kinds[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[begin] = True
        edge[np.flatnonzero(kind == 3)] = True
        if self.spaced:  # white space goes with what follows it in the same text
            after = np.flatnonzero(edge[:-1])
            after = after[(after > 0) & (kind[after] != 0) & (kind[after] != 3)]
            joins = after[kind[after - 1] == 0]
            edge[joins] = False
            edge[begin] = True
        starts = np.flatnonzero(edge)
        starts, ends = starts[:-1], starts[1:]
        if not self.spaced:
            word = kind[starts] != 0
            starts, ends = starts[word], ends[word]
        size = ends - starts
        h = span_hashes(padded, starts, size)
        entry = self.runs.find(h)
        lost = np.flatnonzero(entry < 0)
        if len(lost):
            new, one = np.unique(h[lost], return_index=True)
            one = lost[one]
            if (self.runs.n + len(new) > self.most or max(self.runs.used, self.runs.filled) > 1 << 23) and self.runs.n:
                self.runs = Runs(max(20, (2 * len(new)).bit_length()))
                return self.plain(raws)
            if 2 * (self.runs.n + len(new)) > 1 << self.runs.bits:
                self.runs = Runs((2 * len(new)).bit_length() + 1)
                return self.plain(raws)
            whole = data.tobytes()
            spans = [whole[a:z] for a, z in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
            chunks = [x.decode("latin-1") for x in spans]
            beside = np.fromiter((BESIDE.fullmatch(c) is not None for c in chunks), bool, len(chunks))
            for some in (np.flatnonzero(beside), np.flatnonzero(~beside)):
                for i in range(0, len(some), 4000):
                    part = some[i : i + 4000].tolist()
                    self.runs.add(new[part], [spans[k] for k in part], self.each([chunks[k] for k in part]))
            entry[lost] = self.runs.find(h[lost])
        other = np.flatnonzero(~self.runs.same(entry, padded, starts, size))
        if len(other):  # chunks whose hash another chunk has
            spans = [padded[a:z].tobytes() for a, z in zip(starts[other].tolist(), ends[other].tolist(), strict=True)]
            entry[other] = self.runs.store(spans, self.each([x.decode("latin-1") for x in spans]))
        ids, size = self.runs.flat(entry)
        at = 4 * np.concatenate([[0], np.cumsum(size)])
        cuts = at[np.searchsorted(starts, np.append(begin, len(data)))].tolist()
        raw = ids.tobytes()
        return [raw[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


class Encoder(Chunks):
    """encode(texts) -> ids, equal to the tokenizer's own on each whole text.

    spaced: a word's ids depend on the space before it, and on case (byte-level BPE); else white space only separates, and
    case is dropped.
    """

    def __init__(self, name: str, spaced: bool, end: int | None = None):
        super().__init__()
        self.tokenizer, self.spaced = load(name), spaced
        self.tail = b"" if end is None else np.uint32(end).astype("<u4").tobytes()
        self.separator = "\n" if spaced else " ~ "
        mark = self.tokenizer.encode(self.separator, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def each(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk."""
        if self.mark is None or len(chunks) < 20 or not all(map(BESIDE.fullmatch, chunks)):
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        e = self.tokenizer.encode_batch_fast([self.separator.join(chunks)], add_special_tokens=False)[0]
        ids = np.array(e.ids, "<u4")
        at = np.flatnonzero(ids == self.mark)
        if len(at) != len(chunks) - 1:
            raise RuntimeError("a separator was not kept apart")
        raw, starts, ends = ids.tobytes(), (4 * np.append(0, at + 1)).tolist(), (4 * np.append(at, len(ids))).tolist()
        return [raw[a:z] for a, z in zip(starts, ends, strict=True)]

    def odd(self, text: str) -> bytes:
        """Ids of any text, by chunks that white space parts, or whole."""
        chunks = [text] if ODD.search(text) or "<|" in text else CHUNK.findall(text) if self.spaced else text.split()
        return b"".join(array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, with the end id."""
        out: list[list[bytes]] = [[] for _ in texts]
        mine: list[int] = []
        raws: list[bytes] = []
        size = 0

        def flush() -> None:
            nonlocal size
            for i, ids in zip(mine, self.plain(raws) if raws else (), strict=True):
                out[i].append(ids)
            mine.clear(), raws.clear()
            size = 0

        for i, t in enumerate(texts):
            if not t:
                continue
            if PLAIN.search(t) or "<|" in t:
                out[i].append(self.odd(t))
                continue
            for piece in self.pieces(t if self.spaced else t.lower()):
                mine.append(i)
                raws.append(piece.encode("latin-1"))
                size += len(piece)
                if size >= self.step:
                    flush()
        flush()
        return [b"".join(x) + self.tail for x in out]

    def pieces(self, text: str) -> list[str]:
        """A very long text in pieces, cut before white space that follows other characters."""
        out, at = [], 0
        while len(text) - at > self.step and (m := CUT.search(text, at + self.step)):
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]] if out else [text]

    def encoded(self, texts: list[str], step: int = 500) -> list[bytes]:
        """encode() in steps of bounded size."""
        return [x for i in range(0, len(texts), step) for x in self.encode(texts[i : i + step])]


@lru_cache(maxsize=4)
def encoder(name: str, spaced: bool, end: int | None = None) -> Encoder:
    """One of each kind in a worker process, which keeps its memory from task to task."""
    return Encoder(name, spaced, end)
