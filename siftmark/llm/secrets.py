"""Secret scans: known shapes, and sliding-window entropy per character class with allow-list suppression."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, column_place, keyed, mapped, prepare, table

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Without one of these an assignment cannot match.
CUES = (b"passw", b"secret", b"token", b"apikey", b"api_key")
RUN = 20  # the shortest candidate of the entropy test, and of every shape but `assign`
MEMBER = bytes(c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-" for c in range(256))
#: Character class -> (window, least entropy in bits over the best window). A hex window of 20 has at most 4 bits, others at most log2(window).
LIMITS = {"hex": (20, 3.0), "alnum": (20, 3.7), "single": (24, 3.75), "base64": (24, 3.9)}
#: Never secrets: placeholders, paths, hosts, dates and versions, identifiers in words.
ALLOW = re.compile(
    r"(?i)example|sample|placeholder|changeme|dummy|redacted|your[_-]|xxxx|0000|1234567|abcdef|https?|www\.|\.(?:com|org|net|html?|php|js|css|png|jpe?g|pdf)\b"
    r"|^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$|^[0-9.+=/_-]+$|(.)\1{5}"
)
LOG = [0.0] + [n * math.log2(n) for n in range(1, 65)]


def best_entropy(s: str, window: int) -> float:
    """Most Shannon entropy of a window of s; counts and the sum of n*log2(n) change by one character in and one out."""
    w = min(window, len(s))
    counts: dict[str, int] = {}
    total, best = 0.0, 0.0
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += LOG[n + 1] - LOG[n]
        if i >= w:
            c = s[i - w]
            n = counts[c]
            counts[c] = n - 1
            total += LOG[n - 1] - LOG[n]
        if i >= w - 1:
            best = max(best, math.log2(w) - total / w)
    return best


def classes(s: str) -> tuple[str, bool]:
    """The narrowest class, and whether the characters mix as in generated strings: digits and both cases; hex has any letter, one case alone changes often between letters and digits."""
    digit = any(c.isdigit() for c in s)
    if re.fullmatch(r"[0-9a-fA-F]+", s):
        return "hex", digit and any(c.isalpha() for c in s)
    mixed = digit and any(c.islower() for c in s) and any(c.isupper() for c in s)
    if s.isalnum() and not mixed:
        return "single", digit and sum(a.isdigit() != b.isdigit() for a, b in pairwise(s)) >= 6
    return ("alnum" if s.isalnum() else "base64"), mixed


def is_secret(s: str) -> bool:
    kind, mixed = classes(s)
    window, least = LIMITS[kind]
    if not mixed or len(s) < RUN or ALLOW.search(s):
        return False
    if kind == "base64" and max((len(x) for x in re.split(r"[/_.=+-]", s)), default=0) < 12:
        return False  # words joined by marks, such as paths
    return best_entropy(s, window) >= least


def reaches(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts in ascending order, and the greatest end of the spans up to each."""
    spans = sorted(spans)
    return [s[0] for s in spans], list(accumulate((s[1] for s in spans), max))


def secret_parts(s: str) -> list[tuple[int, int]]:
    """Where s is a secret: as a whole, or else in its parts between slashes, as in the path of an address."""
    if is_secret(s):
        return [(0, len(s))]
    if "/" not in s:
        return []
    return [m.span() for m in re.finditer(r"[^/]+", s) if len(m[0]) >= RUN and is_secret(m[0])]


def scan(raw: bytes) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base, added) spans as (start, end, kind) in code points, sorted by start, then kind as listed."""
    low = raw.translate(LOWER)
    text: str | None = None
    base: list[tuple[int, int, str]] = []
    added: list[tuple[int, int, str]] = []
    if any(c in low for c in CUES):
        text = raw.decode("utf-8", "replace")
        base += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    member = raw.translate(MEMBER)
    at = member.find(b"\1" * RUN)
    done, chars = 0, 0  # chars: code points before byte `done`
    while at >= 0:
        end = member.find(b"\0", at)
        end = len(raw) if end < 0 else end
        chars += len(raw[done:at].decode("utf-8", "replace"))
        run, first = raw[at:end].decode(), chars
        chars, done = chars + end - at, end
        shaped = [(m.start(), m.end(), "access") for m in ACCESS.finditer(run) if m.end() - m.start() >= 20]
        shaped += [(m.start(), m.end(), "hex") for m in HEX.finditer(run) if m.end() - m.start() >= 24]
        base += [(first + a, first + b, k) for a, b, k in shaped]
        starts, ends = reaches(shaped)
        for m in re.finditer(r"[^=]+", run):  # a name before `=` is not part of a value
            a, b = m.span()
            i = bisect_left(starts, b) - 1  # the last shape that starts before b
            if b - a >= RUN and not (i >= 0 and ends[i] > a):
                added += [(first + a + x, first + a + y, "entropy") for x, y in secret_parts(m[0])]
        at = member.find(b"\1" * RUN, end)
    rank = KINDS.index
    base.sort(key=lambda s: (s[0], rank(s[2]), s[1]))
    starts, ends = reaches(base)
    added = [s for s in added if not ((i := bisect_right(starts, s[0]) - 1) >= 0 and ends[i] >= s[1])]
    return base, sorted(base + added, key=lambda s: (s[0], rank(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(raw: bytes, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with every span, or union of overlapping spans, replaced by the mark."""
    text = raw.decode("utf-8", "replace")
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def secret_scan(df: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per row: base counts, the base spans' sha256 and all spans. Null and empty texts have none. Repeated rows are scanned alike.

    A very long text costs time in proportion to its length, also where it is full of hits. An empty table gives no rows.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scan(x or b"") for x in b.column(1).cast(pa.binary()).to_pylist()]
            counts = [pa.array([sum(s[2] == k for s in base) for base, _ in got], pa.int64()) for k in KINDS[:3]]
            sha = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, sha, pa.array([joined(x) for _, x in got], pa.string())], ["key", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return keyed(df, run, id_column, ["text"], {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string"})


def redacted(df: DataFrame) -> DataFrame:
    """df with its secrets replaced by [SECRET]; every row and column stays. Null texts stay null; n_chars, if there, follows the text."""
    prepare(df.sparkSession)
    place, names = column_place(df, "text"), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(place).cast(pa.binary()).to_pylist():
                spans = scan(x)[1] if x else []
                out.append(redact(x, spans) if spans else x and x.decode("utf-8", "replace"))
            yield b.set_column(place, b.schema.names[place], pa.array(out, pa.string()))

    out = mapped(df, run, df.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(df.dtypes)["n_chars"])) if "n_chars" in names else out


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
