"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one pass that keeps the best way to each position."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import groupby, pairwise

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_place, mapped, prepare, table, with_columns
from .tokenizing import Chunks

SPACE = "▁"


def joined_with(pieces: Iterable[str], char: str) -> set[str]:
    """The characters that pieces join to `char`, directly or through others; no piece holds one of them beside any other character."""
    beside: dict[str, set[str]] = {}
    for p in pieces:
        for a, b in pairwise(p.lstrip(SPACE)):
            beside.setdefault(a, set()).add(b)
            beside.setdefault(b, set()).add(a)
    found, waiting = {char}, [char]
    while waiting:
        new = beside.get(waiting.pop(), set()) - found
        found |= new
        waiting += new
    return found


class Pieces(Chunks):
    """The pieces of a model file and their scores. kind: "unigram" takes the segmentation of greatest score sum; "bpe" the one that merging makes.

    Both run through the automaton once: at each position the output links give the pieces that end there, longest first, and
    each relaxes the best way to that position. A unigram piece relaxes by score. For BPE a sum of scores gives other results
    than the model's own, so a piece relaxes a position only if merging would keep it apart from the piece before it, which
    holds for exactly one piece at each position that a prefix's encoding can end in.
    """

    most = 400_000

    def __init__(self, model: str, kind: str = "bpe"):
        super().__init__()
        m = sentencepiece.SentencePieceProcessor(model_file=model)
        n = m.get_piece_size()
        self.kind = kind
        self.byte = [m.piece_to_id(f"<0x{i:02X}>") for i in range(256)]
        plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.id = {m.id_to_piece(i): i for i in plain}
        self.score = {m.id_to_piece(i): m.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece has a space inside; chunks can't be encoded apart")
        self.bytes_of = [b""] * n
        for p, i in self.id.items():
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        for v, i in enumerate(self.byte):
            self.bytes_of[i] = bytes([v])
        self.piece = {i: p for p, i in self.id.items()}
        self.size = [len(self.piece.get(i, "")) for i in range(n)]
        self.chars = {p for p in self.id if len(p) == 1}
        #: Spaces and the word or the marks after them, line breaks, other spaces: no piece reaches from one chunk into the next.
        beside = joined_with(self.id, "e") - {"\n", SPACE}
        word = "".join(map(re.escape, sorted(beside)))
        self.cut = re.compile(f"{SPACE}*(?:[{word}]+|[^{word}{SPACE}\n]+)|\n|{SPACE}+")
        self.kinds = np.array([3 if c == 10 else 0 if c == 32 else 1 if chr(c) in beside else 2 for c in range(256)], np.uint8)
        self.apart: dict[int, bool] = {}
        size = np.array([len(x) for x in self.bytes_of], np.int64)
        self.shown, self.shown_size, self.shown_first = np.frombuffer(b"".join(self.bytes_of), np.uint8), size, np.cumsum(size) - size

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Made when first asked for; a worker that only decodes needs none."""
        out = ahocorasick.Automaton()
        for p, i in self.id.items():
            if self.kind == "unigram" or self.merged(p) == [p]:  # merging never makes other pieces
                out.add_word(p, i)
        out.make_automaton()
        return out

    def merged(self, s: str) -> list[str]:
        """Merging by definition, for short strings: the pair with the best score first, the leftmost of equal ones."""
        parts = list(s)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stays(self, key: int) -> bool:
        """Whether merging keeps two pieces apart; key: the first's id times the number of ids, plus the second's."""
        if len(self.apart) > self.most:
            self.apart.clear()
        a, b = (self.piece[i] for i in divmod(key, len(self.size)))
        self.apart[key] = got = self.merged(a + b) == [a, b]
        return got

    def best(self, s: str) -> list[str]:
        """The pieces of a string of known characters."""
        return [self.piece[i] for i in self.way(s)]

    def way(self, s: str) -> list[int]:
        """Their ids."""
        if self.kind == "bpe" and s.startswith(SPACE * 2):  # runs of spaces have equal scores, where only merging itself decides
            return [self.id[p] for p in self.merged(s)]
        n, size = len(s), self.size
        last = [-1] * (n + 1)
        if self.kind == "unigram":
            total = [0.0] + [float("-inf")] * n
            for end, i in self.automaton.iter(s):
                value = total[end + 1 - size[i]] + self.score[self.piece[i]]
                if value > total[end + 1]:
                    total[end + 1], last[end + 1] = value, i
        else:
            apart, many = self.apart.get, len(size)
            for end, i in self.automaton.iter(s):
                end += 1
                if last[end] < 0:
                    start = end - size[i]
                    if start:
                        if last[start] < 0:
                            continue
                        key = last[start] * many + i
                        far = apart(key)
                        if not (self.stays(key) if far is None else far):
                            continue
                    last[end] = i
        out = []
        while n:
            out.append(last[n])
            n -= size[last[n]]
        return out[::-1]

    def chunk(self, s: str) -> bytes:
        """Ids of a chunk as little-endian 32-bit integers; characters that are no piece become their bytes' pieces."""
        if self.chars.issuperset(s):
            return array("I", self.way(s)).tobytes()
        ids: list[int] = []
        for known, run in groupby(s, self.chars.__contains__):
            part = "".join(run)
            ids += self.way(part) if known else [self.byte[v] for v in part.encode("utf-8", "replace")]
        return array("I", ids).tobytes()

    def each(self, chunks: list[str]) -> list[bytes]:
        return [self.chunk(c.replace(" ", SPACE)) for c in chunks]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids as the model's library gives them: a space before the text, and no other normalisation. Empty text has none."""
        out = [b""] * len(texts)
        mine: list[int] = []
        raws: list[bytes] = []
        size = 0
        for i, t in enumerate(texts):
            if not t:
                continue
            try:
                raw = b" " + t.encode("latin-1")
            except UnicodeEncodeError:
                out[i] = b"".join(map(self.chunk, self.cut.findall(SPACE + t.replace(" ", SPACE))))
                continue
            mine.append(i)
            raws.append(raw)
            size += len(raw)
            if size >= self.step:
                for k, ids in zip(mine, self.plain(raws), strict=True):
                    out[k] = ids
                mine, raws, size = [], [], 0
        for k, ids in zip(mine, self.plain(raws) if raws else (), strict=True):
            out[k] = ids
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        e = np.frombuffer(ids, "<u4")
        size = self.shown_size[e]
        at = np.repeat(self.shown_first[e] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return self.shown[at].tobytes().decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=2)
def load(model: str, kind: str) -> Pieces:
    return Pieces(model if "/" in model else public_tokenizers.path(model), kind)


def _mapped(df: DataFrame, source: str, target: str, kind: str, f) -> DataFrame:
    prepare(df.sparkSession)
    kept = df.drop(target)
    place, t = column_place(kept, source), {"binary": pa.binary(), "string": pa.string()}[kind]
    names = [f"_{i}" for i in range(len(kept.columns) + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                some = b.slice(i, 1000)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(f(some.column(place).to_pylist()), t)], names)

    return mapped(kept, run, with_columns(kept, **{target: kind}))


def encode(df: DataFrame, model: str = "piece_bpe_32k.model", kind: str = "bpe", text: str = "text", ids: str = "ids") -> DataFrame:
    """df with a column of ids (little-endian unsigned 32-bit). Null and empty texts have no ids. A column of that name is replaced.

    Of ways to cut a text that score alike the first found stays, so equal texts have equal ids. Repeated rows are encoded alike,
    an empty table gives no rows. A text is encoded whole, however long: some ten arrays of its length are held meanwhile.
    """
    return _mapped(df, text, ids, "binary", lambda xs: load(model, kind).encode_all([x or "" for x in xs]))


def decode(df: DataFrame, model: str = "piece_bpe_32k.model", kind: str = "bpe", ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with a column of decoded text. Null ids decode to an empty text."""
    return _mapped(df, ids, text, "string", lambda xs: [load(model, kind).decode(x or b"") for x in xs])


def both_ways(df: DataFrame, model: str = "piece_bpe_32k.model", text: str = "text") -> DataFrame:
    """df with the texts' ids and decoded text in two ways: by the scores alone (viterbi_ids, viterbi_text) and as the model's own merging gives them (ids, decoded).

    One pass through Python; nulls and empty texts have no ids, columns of these names are replaced. Ties, repeated rows, long
    texts and empty tables as in encode().
    """
    prepare(df.sparkSession)
    added = {"viterbi_ids": "binary", "viterbi_text": "string", "ids": "binary", "decoded": "string"}
    kept = df.drop(*added)
    place, names = column_place(kept, text), [f"_{i}" for i in range(len(kept.columns) + len(added))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = [load(model, kind) for kind in ("unigram", "bpe")]
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                some = b.slice(i, 1000)
                xs = [x or "" for x in some.column(place).to_pylist()]
                made: list[pa.Array] = []
                for m in by:
                    ids = m.encode_all(xs)
                    made += [pa.array(ids, pa.binary()), pa.array(map(m.decode, ids), pa.string())]
                yield pa.RecordBatch.from_arrays([*some.columns, *made], names)

    return mapped(kept, run, with_columns(kept, **added))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded both ways: ids by count and checksum, and whether the text comes back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = F.translate("text", SPACE, " ")
    out = []
    for ids, text, name in (("viterbi_ids", "viterbi_text", "viterbi_"), ("ids", "decoded", "")):
        out += [(F.octet_length(ids) / 4).cast("long").alias(f"{name}n_tokens"), F.crc32(ids).alias(f"{name}ids_crc32"), (F.col(text) == whole).alias(f"{name}round_trip")]
    return both_ways(docs).select("doc_id", *out)
