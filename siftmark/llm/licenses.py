"""License scans: ordered signature rules over normalised words, gated by keywords, overlaps resolved by priority and containment."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import keyed, prepare, table
from .license_wordings import WORDINGS

#: A-Z become a-z and other ASCII characters than letters and digits become spaces, so that split() gives the words.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

#: Phrases that always count, at every place where their words stand in a row.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label, family name as a regex over words, versions as (regex, suffix); "" is a name without version.
FAMILIES = (
    ("apache", "apache(?: software)?", (("2(?: 0)?", "-2"), ("1 1", "-1.1"), ("1(?: 0)?", "-1"))),
    ("gpl", "(?:gnu )?(?:gpl|general public licen[sc]e)", (("3(?: 0)?", "-3"), ("2(?: 0)?", "-2"), ("1(?: 0)?", "-1"))),
    ("lgpl", "(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[sc]e)", (("3(?: 0)?", "-3"), ("2 1", "-2.1"), ("2(?: 0)?", "-2"))),
    ("agpl", "(?:gnu )?(?:agpl|affero general public licen[sc]e)", (("3(?: 0)?", "-3"), ("1(?: 0)?", "-1"))),
    ("gfdl", "(?:gnu )?(?:gfdl|free documentation licen[sc]e)", (("1 3", "-1.3"), ("1 2", "-1.2"), ("1 1", "-1.1"))),
    ("mpl", "(?:mpl|mozilla public(?: licen[sc]e)?)", (("2(?: 0)?", "-2"), ("1 1", "-1.1"), ("1(?: 0)?", "-1"))),
    ("epl", "(?:epl|eclipse public(?: licen[sc]e)?)", (("2(?: 0)?", "-2"), ("1(?: 0)?", "-1"))),
    ("cddl", "(?:cddl|common development and distribution(?: licen[sc]e)?)", (("1 1", "-1.1"), ("1(?: 0)?", "-1"))),
    ("eupl", "(?:eupl|european union public(?: licen[sc]e)?)", (("1 2", "-1.2"), ("1 1", "-1.1"))),
    ("bsl", "(?:boost software(?: licen[sc]e)?)", (("1(?: 0)?", "-1"),)),
    ("artistic", "(?:artistic(?: licen[sc]e)?)", (("2(?: 0)?", "-2"), ("1(?: 0)?", "-1"))),
    ("afl", "(?:afl|academic free(?: licen[sc]e)?)", (("3(?: 0)?", "-3"), ("2 1", "-2.1"))),
    ("osl", "(?:osl|open software licen[sc]e)", (("3(?: 0)?", "-3"), ("2 1", "-2.1"))),
    ("ofl", "(?:sil )?(?:ofl|open font licen[sc]e)", (("1 1", "-1.1"), ("1(?: 0)?", "-1"))),
    ("busl", "(?:busl|business source licen[sc]e)", (("1 1", "-1.1"),)),
    ("sspl", "(?:sspl|server side public licen[sc]e)", (("1(?: 0)?", "-1"),)),
    ("elastic", "elastic licen[sc]e", (("2(?: 0)?", "-2"),)),
    ("cecill", "cecill(?: [bc])?", (("2 1", "-2.1"), ("2(?: 0)?", "-2"))),
    ("zpl", "(?:zpl|zope public(?: licen[sc]e)?)", (("2 1", "-2.1"), ("2(?: 0)?", "-2"))),
    ("odbl", "(?:odbl|open (?:data commons open )?database licen[sc]e)", (("1(?: 0)?", "-1"),)),
    ("mit", "(?:mit|x11|expat)", ()),
    ("isc", "isc", ()),
    ("zlib", "(?:zlib|zlib libpng)", ()),
    ("bsd-2", "(?:(?:simplified|2 clause|two clause) bsd|bsd (?:2|two) clause|freebsd)", ()),
    ("bsd-3", "(?:(?:modified|revised|new|3 clause|three clause) bsd|bsd (?:3|three) clause)", ()),
    ("bsd", "bsd", ()),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public)", ()),
    ("beerware", "beer ?ware", ()),
    ("postgresql", "postgresql", ()),
    ("python", "(?:python software foundation|psf)", ()),
    ("php", "php", ()),
    ("ruby", "ruby", ()),
    ("unlicense", "unlicense", ()),
)
#: Of each family, what one of must stand in a text that names it.
NAMES = {
    "apache": (" apache",), "gpl": (" gpl", "general public licen"), "lgpl": (" lgpl", "general public licen"), "agpl": (" agpl", " affero"), "gfdl": (" gfdl", "free documentation"), "mpl": (" mpl", "mozilla public"), "epl": (" epl", "eclipse public"),
    "cddl": (" cddl", "common development"), "eupl": (" eupl", "european union public"), "bsl": (" bsl", "boost software"), "artistic": (" artistic",), "afl": (" afl", "academic free"), "osl": (" osl", "open software"), "ofl": (" ofl", "open font"),
    "busl": (" busl", "business source"), "sspl": (" sspl", "server side public"), "elastic": ("elastic licen",), "cecill": (" cecill",), "zpl": (" zpl", "zope public"), "odbl": (" odbl", "database licen"),
    "mit": (" mit ", " x11 ", " expat "), "isc": (" isc ",), "zlib": (" zlib ",), "bsd-2": ("bsd ",), "bsd-3": ("bsd ",), "bsd": ("bsd ",), "wtfpl": (" wtfpl ", "do what the"), "beerware": (" beer",), "postgresql": (" postgresql ",),
    "python": ("python software foundation", " psf "), "php": (" php ",), "ruby": (" ruby ",), "unlicense": (" unlicense ",),
}
CC_PARTS = (("by", "attribution"), ("nc", "non ?commercial"), ("sa", "share ?alike"), ("nd", "no ?deriv(?:atives|s)?(?: works)?"))
CC_KINDS = (("by", "nc", "nd"), ("by", "nc", "sa"), ("by", "nc"), ("by", "nd"), ("by", "sa"), ("by",))
CC_VERSIONS = ("4 0", "3 0", "2 5", "2 0", "1 0")


@dataclass(frozen=True)
class Signature:
    label: str
    pattern: re.Pattern[bytes]
    keywords: tuple[bytes, ...]  # every match holds one of them
    priority: int  # the larger wins an overlap
    score: float


@cache
def signatures() -> tuple[Signature, ...]:
    """All rules: sentences and notices that are written out one by one, then names with their versions; the most specific first. A match starts and ends at a word's edge."""
    rules: list[Signature] = []

    def add(label: str, words: str, keywords: str | tuple[str, ...], priority: int, score: float) -> None:
        gate = (keywords,) if isinstance(keywords, str) else keywords
        rules.append(Signature(label, re.compile(rf"(?<= ){words}(?= )".encode()), tuple(k.encode() for k in gate), priority, score))

    for phrase, label in BASE:
        add(label, phrase, phrase, 100, 1.0)
    for label, words, keyword in WORDINGS:
        add(label, words, keyword, 80, 0.95)
    for kind in CC_KINDS:
        label, short, long = "cc-" + "-".join(kind), "cc " + " ".join(kind), " ".join(dict(CC_PARTS)[x] for x in kind)
        for v in CC_VERSIONS:
            add(f"{label}-{v.replace(' ', '.')}", f"(?:{short}|creative commons {long}) (?:licen[sc]e )?(?:version )?{v}", ("cc by", "creative commons"), 70 + len(kind), 0.98)
        add(label, f"creative commons {long}(?: licen[sc]e)?", "creative commons", 60 + len(kind), 0.9)
        add(label, short, short, 50 + len(kind), 0.9 if len(kind) > 1 else 0.6)  # "cc by" alone may be plain words
        add(label, f"creativecommons org licenses {' '.join(kind)}", "creativecommons", 60 + len(kind), 0.98)
    add("cc0", "(?:cc0|creative commons zero)(?: licen[sc]e)?(?: 1 0)?", ("cc0", "creative commons zero"), 60, 0.95)
    add("cc0", "creative commons zero(?: 1 0)?", "creative commons", 60, 0.95)
    for name, words, versions in FAMILIES:
        for number, suffix in versions:
            joined = f"{words}(?:(?: licen[sc]e)? (?:version |v ?)?|v?){number}"
            add(name + suffix, f"(?:the )?{joined}(?: or (?:any )?later)?(?: licen[sc]e)?", NAMES[name], 40, 0.85)
            add(name + suffix, f"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of the )?{joined}", NAMES[name], 45, 0.95)
            add(name + suffix, f"spdx license identifier {name} {number}(?: only| or later)?", "spdx license identifier", 90, 1.0)
        add(name, f"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of the )?{words}(?: licen[sc]e)?", NAMES[name], 35, 0.9)
        add(name, f"(?:the )?{words} licen[sc]e", NAMES[name], 30, 0.75)
        add(name, f"licen[sc]e (?:is )?{words}", NAMES[name], 20, 0.6)
        add(name, f"spdx license identifier {name.replace('-', ' ')}", "spdx license identifier", 85, 1.0)
    return tuple(sorted(rules, key=lambda r: -r.priority))


def places(norm: bytes, phrase: bytes) -> Iterator[int]:
    """Offsets of ` phrase ` in norm, which may share the space between them."""
    at = norm.find(phrase)
    while at >= 0:
        yield at
        at = norm.find(phrase, at + 1)


def resolved(found: list[tuple[int, int, str, float, int]], size: int) -> list[tuple[int, int, str, float, int]]:
    """The detections that stay: one goes if a stronger one overlaps it, or if one as strong contains it; of equal ones the first label stays.

    What holds a whole base phrase and more is stronger than the phrase. The work grows with the detections' total length.
    """
    phrases = sorted(x[:2] for x in found if x[4] == 100)
    own, starts, ends = set(phrases), [p[0] for p in phrases], [p[1] for p in phrases]
    for i in range(len(ends) - 2, -1, -1):  # the least end of the phrases from each one on
        ends[i] = min(ends[i], ends[i + 1])
    levels: dict[int, list[tuple[int, int, str, float, int]]] = {}
    for x in found:
        i = bisect_left(starts, x[0])
        wider = i < len(starts) and ends[i] <= x[1] and (x[0], x[1]) not in own
        levels.setdefault(x[4] + 1000 * wider, []).append(x)
    covered, kept = bytearray(size), []
    for level in sorted(levels, reverse=True):
        mine, reach = [], 0
        for x in sorted(levels[level], key=lambda x: (x[0], -x[1], x[2])):
            if x[1] > reach and covered.find(1, x[0], x[1]) < 0:
                mine.append(x)
                reach = x[1]
        for x in mine:
            covered[x[0] : x[1]] = b"\1" * (x[1] - x[0])
        kept += mine
    return kept


class Gate:
    """One automaton over the keywords of all rules, which tells in one pass which rules a text may match."""

    held: dict[int, Gate] = {}  # by the rules' place in memory; each holds its rules, so that no other takes that place

    def __init__(self, rules: tuple[Signature, ...]):
        self.rules, self.automaton = rules, ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            for k in r.keywords:
                by.setdefault(k.decode("latin-1"), []).append(i)
        for k, numbers in by.items():
            self.automaton.add_word(k, (k, tuple(numbers)))
        self.automaton.make_automaton()

    @staticmethod
    def of(rules: tuple[Signature, ...]) -> Gate:
        if id(rules) not in Gate.held:
            Gate.held[id(rules)] = Gate(rules)
        return Gate.held[id(rules)]

    def open(self, norm: bytes) -> list[Signature]:
        """The rules of which a keyword stands in the words, in their order."""
        found = {v for _, v in self.automaton.iter(norm.decode("latin-1"))}
        return [self.rules[i] for i in sorted({i for _, numbers in found for i in numbers})]


def scan(raw: bytes, rules: tuple[Signature, ...]) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str, float]]]:
    """Word count, base places and kept detections, as (first word, end word, label[, score])."""
    words = raw.translate(NORMAL).split()
    norm = b" " + b" ".join(words) + b" "
    starts: list[int] = []

    def word(at: int) -> int:
        if not starts:
            starts.extend(i for i, c in enumerate(norm) if c == 32)
        return bisect_right(starts, at - 1) - 1

    base = [(word(at + 1), word(at + 1) + len(p.split()), label) for p, label in BASE for at in places(norm, f" {p} ".encode())]
    found: list[tuple[int, int, str, float, int]] = []
    for r in Gate.of(rules).open(norm):
        found.extend((m.start(), m.end(), r.label, r.score, r.priority) for m in r.pattern.finditer(norm))
    kept = resolved(found, len(norm))
    return len(words), base, [(word(a), word(b - 1) + 1, label, s) for a, b, label, s, _ in sorted(kept)]


def license_scan(df: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per row: words, base places, labels, best score and the kept detections as (first word, end word, label, score).

    Null and empty texts have no words and no labels, score 0. Repeated rows are scanned alike, other columns are not carried.
    Detections are resolved by resolved(); base phrases always stay in base_labels and labels. A very long text costs time in
    proportion to its length, also where it is full of hits. An empty table gives no rows.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = signatures()
        for b in batches:
            out = []
            for x in b.column(1).cast(pa.binary()).to_pylist():
                n, base, kept = scan(x or b"", rules)
                at = [p[0] for p in base]
                out.append({
                    "n_words": n, "n_base": len(base), "first_word": min(at, default=None), "last_word": max(at, default=None),
                    "base_labels": ",".join(sorted({p[2] for p in base})), "labels": ",".join(sorted({p[2] for p in base} | {p[2] for p in kept})),
                    "score": max([p[3] for p in kept] + [1.0] * bool(base), default=0.0), "detections": [dict(zip(("first", "end", "label", "score"), p, strict=True)) for p in kept],
                })
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("score", pa.float64())]))
            fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", kind)]
            got = pa.Table.from_pylist(out, pa.schema(fields)).combine_chunks()
            yield from pa.table([b.column(0), *got.columns], names=["key", *got.column_names]).to_batches()

    kinds = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double", "detections": "array<struct<first:long,end:long,label:string,score:double>>"}
    return keyed(df, run, id_column, ["text"], kinds)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")
