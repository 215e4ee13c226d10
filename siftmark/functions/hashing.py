"""Hashes and checksums: SHA-256, SimHash over FNV-1a tokens, Hamming distance, Luhn, cosine."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A run of letters and decimal digits; a CJK ideograph ends the token it stands in.
TOKEN = regex.compile(r"(?:[\p{L}\p{Nd}]|[一-鿿])(?:(?![一-鿿])[\p{L}\p{Nd}])*[一-鿿]?")
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
LONG = 64  # bytes of a token that are hashed beside others


def fnv1a(data: bytes) -> int:
    h = OFFSET
    for b in data:
        h = (h ^ b) * PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_all(tokens: list[bytes]) -> np.ndarray:
    """fnv1a() of each, a byte of all at a time."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    order = np.argsort(-size, kind="stable")
    data = np.frombuffer(b"".join(tokens), np.uint8)
    at, size = (np.cumsum(size) - size)[order], size[order]
    h = np.full(len(tokens), OFFSET, np.uint64)
    for i in range(min(LONG, int(size[0]) if len(size) else 0)):
        live = int(np.searchsorted(-size, -i))  # those longer than i stand first
        h[:live] = (h[:live] ^ data[at[:live] + i]) * np.uint64(PRIME)
    out = np.empty_like(h)
    out[order] = h
    for k in order[: int(np.searchsorted(-size, -LONG))].tolist():
        out[k] = fnv1a(tokens[k])
    return out


def simhashes(texts: list[str]) -> np.ndarray:
    """A bit is set where more tokens have it than not; a text without tokens is 0."""
    place: dict[str, int] = {}
    flat: list[int] = []
    ends = []
    for t in texts:
        flat += [place.setdefault(w, len(place)) for w in TOKEN.findall(t.lower())]
        ends.append(len(flat))
    h = fnv1a_all([w.encode() for w in place])
    signs = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8) * 2 - 1
    out, start, flat = np.zeros(len(texts), np.uint64), 0, np.array(flat, np.int64)
    for k, end in enumerate(ends):
        own, n = np.unique(flat[start:end], return_counts=True)
        votes = n.astype(np.float32) @ signs[own].astype(np.float32) if len(own) else np.zeros(64)
        out[k] = np.packbits(votes > 0, bitorder="little").view("<u8")[0]
        start = end
    return out


@F.arrow_udf(StringType())
def simhash(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for s in texts:  # few texts at a time are Python objects
        parts = [simhashes([t or "" for t in s.slice(i, 500).to_pylist()]) for i in range(0, len(s), 500)]
        yield pa.array([f"{x:016x}" for p in parts for x in p.tolist()], pa.string())


def simhash_bits(hex16: Column) -> Column:
    """The 16 hex digits as a signed 64-bit integer."""
    return F.conv(hex16, 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def is_card(number: Column) -> Column:
    return F.call_function("luhn_check", number) & F.length(number).between(16, 19)


def cosine(a: Column, b: Column) -> Column:
    """Null where sizes differ or a vector is empty or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)
