"""Which encoding bytes are in: byte order marks, zero bytes, valid UTF-8, and else the likelihood of byte pairs under models.

A model is a table of log probabilities of two neighbouring bytes, as texts in that encoding have them. The models that are
there by default are fitted to texts made by rules: letters with and without marks in words, and the common characters of
the Chinese sets in the order of their codes. fitted() makes models of a user's own texts.
"""

from __future__ import annotations

import codecs
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
ENCODINGS = ("gb18030", "big5", "cp1252")
PRIOR = {"gb18030": 4.0}  # in the logarithm: of texts too short to tell, this is likelier
SAMPLE = 2000  # texts that models are fitted to, at most
SAMPLE_CHARS = 4000  # of each

Models = dict[str, np.ndarray]


def pairs(data: bytes) -> np.ndarray:
    """Neighbouring bytes of which one is not ASCII, as one number each; others say the same in every encoding."""
    x = np.frombuffer(b" " + data + b" ", np.uint8)
    both = (x[:-1].astype(np.uint16) << 8) | x[1:]
    return both[(x[:-1] > 127) | (x[1:] > 127)]


def model(texts: list[bytes], base: np.ndarray | None = None) -> np.ndarray:
    """Log probabilities of pairs; unseen ones count as half of one, or as in `base`."""
    count = sum((np.bincount(pairs(t), minlength=1 << 16) for t in texts), np.zeros(1 << 16))
    prior, weight = (1 / (1 << 16), 1 << 15) if base is None else (np.exp(base.astype(np.float64)), 20_000)
    return np.log((count + weight * prior) / (count.sum() + weight)).astype(np.float32)


@lru_cache(maxsize=1)
def default() -> Models:
    marked = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
    plain = "etaoinshrdlu"
    latin = [" ".join(a + m + b for a in plain for b in plain) for m in marked] + [f" {m}{a} {a}{m} {a}{m}." for m in marked for a in plain] + ["«a» 5€ a–b „a“ ‚a‘ a’s 10° §1 £5 ¿a? ¡a! a… 2² ½"]
    gb = bytes(b for hi in range(0xB0, 0xD8) for lo in range(0xA1, 0xFF) for b in (hi, lo) if not (hi == 0xD7 and lo > 0xF9))
    # Big5 goes by strokes, and characters of few strokes are the more frequent ones
    big5 = bytes(b for hi in range(0xA4, 0xC7) for _ in range(4 if hi < 0xAE else 2 if hi < 0xB8 else 1) for lo in (*range(0x40, 0x7F), *range(0xA1, 0xFF)) for b in (hi, lo) if not (hi == 0xC6 and lo > 0x7E))

    def mixed(data: bytes) -> list[bytes]:
        """Characters in many orders, with the set's own marks and some ASCII between."""
        chars = np.frombuffer(data, np.uint8).reshape(-1, 2)
        rng = np.random.default_rng(5)
        return [rng.permutation(chars).tobytes() for _ in range(6)]

    signs = "，。、：；（）《》"
    return {
        "cp1252": model([t.encode("cp1252", "ignore") for t in latin]),
        "gb18030": model([*mixed(gb), *(f"的{s}一".encode("gb18030") * 300 for s in signs)]),
        "big5": model([*mixed(big5), *(f"的{s}一".encode("big5") * 300 for s in signs if s in "，。、：；（）《》")]),
    }


def fitted(texts: list[str], encodings: tuple[str, ...] = ENCODINGS) -> Models:
    """Models of texts, each in all encodings that have its characters; on top of the default ones, where there are such."""
    known, out = default(), dict(default())
    for e in encodings:
        raws = []
        for t in texts[:SAMPLE]:
            try:
                raws.append(t[:SAMPLE_CHARS].encode(e))
            except UnicodeEncodeError:
                continue
        if raws:
            out[e] = model(raws, known.get(e))
    return out


def fitted_to(samples: DataFrame, text: str = "text", encodings: tuple[str, ...] = ENCODINGS) -> Models:
    """fitted() on up to SAMPLE texts of a frame, of SAMPLE_CHARS characters each, those with the smallest hashes."""
    some = samples.where(F.col(text).isNotNull()).select(F.substring(text, 1, SAMPLE_CHARS).alias("t"), F.xxhash64(text).alias("h")).orderBy("h").limit(SAMPLE)
    return fitted([r.t for r in some.collect()], encodings)


def detect(data: bytes, models: Models | None = None) -> str | None:
    """The encoding, or None where no encoding that has a model can be it."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return name
    if b"\0" in data and len(data) % 2 == 0:
        x = np.frombuffer(data, np.uint8).reshape(-1, 2)
        zeros = (x == 0).mean(0)  # ASCII letters have a zero on one side, spaces and line ends even among other scripts
        if zeros.max() >= 0.02 and zeros.min() * 4 <= zeros.max():
            guess = "utf-16-le" if zeros[1] > zeros[0] else "utf-16-be"
            if readable(data, guess):
                return guess
    if readable(data, "utf-8"):
        return "utf-8"
    given = models or default()
    both = pairs(data)
    found = [(float(m[both].sum()) + PRIOR.get(e, 0.0), e) for e, m in given.items() if readable(data, e)]
    return max(found)[1] if found else None


def readable(data: bytes, encoding: str) -> bool:
    try:
        data.decode(encoding)
    except (UnicodeDecodeError, LookupError):
        return False
    return True


def decoded(data: bytes, models: Models | None = None) -> tuple[str, str | None]:
    """(text, error): bytes that no encoding has are read as UTF-8, with a mark for each that is none, and told."""
    encoding = detect(data, models)
    if encoding is None:
        return data.decode("utf-8", "replace"), "no known encoding"
    try:
        return data.decode(encoding), None
    except UnicodeDecodeError as e:  # behind a mark
        return data.decode(encoding, "replace"), f"{encoding}: {e.reason} at {e.start}"
