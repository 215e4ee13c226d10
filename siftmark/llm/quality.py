"""Quality rules as a short-circuit cascade, ordered by rejections per second as measured on a sample."""

from __future__ import annotations

import contextlib
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_place, mapped, prepare, table, with_columns


class Document:
    """One text with its measures, each computed when first asked for. Words: runs of other characters than 0x20 and 0x09-0x0D."""

    def __init__(self, raw: bytes):
        self.raw = raw

    def __getattr__(self, name: str):
        value = getattr(type(self), f"_{name}")(self)
        setattr(self, name, value)
        return value

    def _words(self) -> list[bytes]:
        return self.raw.split()

    def _n_words(self) -> int:
        return len(self.words)

    def _word_chars(self) -> int:
        """Code points are the bytes that do not continue one."""
        joined = b"".join(self.words)
        return len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))

    def _n_symbols(self) -> int:
        return sum(map(self.raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))

    def _n_dup_lines(self) -> int:
        lines = [x for x in self.raw.split(b"\n") if x.strip()]
        return len(lines) - len(set(lines))

    def _n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        found = Counter(windows)
        if len(found) == len(windows):
            return 0
        total, covered = 0, 0  # covered: the first word not counted yet
        for i, x in enumerate(windows):
            if found[x] > 1:
                total += i + 3 - max(i, covered)
                covered = i + 3
        return total


    def _text_lines(self) -> list[bytes]:
        return [x for x in map(bytes.strip, self.raw.split(b"\n")) if x]

    def _n_bullets(self) -> int:
        return sum(x.startswith((b"-", b"*", BULLET)) for x in self.text_lines)

    def _n_ellipses(self) -> int:
        return sum(x.endswith((b"...", ELLIPSIS)) for x in self.text_lines)

    def _n_lettered(self) -> int:
        """Words with a letter of ASCII or any other character beyond it."""
        return sum(1 for _ in LETTERED.finditer(self.raw))

    def _n_distinct(self) -> int:
        return len(set(self.words))


BULLET, ELLIPSIS = "•".encode(), "…".encode()
LETTERED = re.compile(rb"[^\x20\t-\r]*?[A-Za-z\x80-\xff][^\x20\t-\r]*")


@dataclass(frozen=True)
class Rule:
    """fails(document) with the measures it needs; pure, so that the order of rules never changes a verdict."""

    name: str
    fails: Callable[[Document], bool]


#: Mild limits after published web-corpus filters: what they reject is not prose, and a clean document passes with room to spare.
RULES = (
    Rule("few_words", lambda d: d.n_words < 50),
    Rule("repeated_windows", lambda d: 100 * d.n_repeat_words > 50 * d.n_words),
    Rule("word_length", lambda d: d.word_chars > 12 * d.n_words or d.word_chars < 2 * d.n_words),
    Rule("symbols", lambda d: 10 * d.n_symbols > 3 * d.n_words),
    Rule("repeated_lines", lambda d: 2 * d.n_dup_lines > d.raw.count(b"\n") + 1),
    Rule("bullet_lines", lambda d: 10 * d.n_bullets > 9 * len(d.text_lines)),
    Rule("ellipsis_lines", lambda d: 10 * d.n_ellipses > 3 * len(d.text_lines)),
    Rule("letters", lambda d: 2 * d.n_lettered < d.n_words),
    Rule("few_distinct_words", lambda d: 100 * d.n_distinct < d.n_words),
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def some_files(df: DataFrame, most: int = 8) -> DataFrame:
    """df over a few of its files, evenly spaced in the order of their names; df's own reader does not open the others.

    A frame that does not know its rows' files (a join, say) is given back as it is.
    """
    names = sorted(df.inputFiles())
    if len(names) <= most:
        return df
    path = F.regexp_replace("_metadata.file_path", "^file:/+", "file:///")
    with contextlib.suppress(AnalysisException):
        return df.where(path.isin([re.sub("^file:/+", "file:///", names[i * len(names) // most]) for i in range(most)]))
    return df


def measure(sample: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = 128, given: tuple[str, ...] = ()) -> dict[str, tuple[float, float]]:
    """name -> (seconds, rejected share) per document, from up to `rows` rows of the first batch of each partition of the sample.

    Each rule is timed on a fresh document, so it pays for all that it needs but the measures `given`, which are made anyway.
    """

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, hits, n = [0.0] * len(rules), [0] * len(rules), 0
        for b in batches:
            texts = b.column(0).cast(pa.binary())
            step = max(1, -(-len(texts) // rows))
            for i in range(0, len(texts), step):
                n += 1
                for k, r in enumerate(rules):
                    d = Document(texts[i].as_py() or b"")
                    for x in given:
                        getattr(d, x)
                    t = time.perf_counter()
                    hits[k] += bool(r.fails(d))
                    cost[k] += time.perf_counter() - t
            if n:
                break  # the rest is not read
        yield pa.RecordBatch.from_pydict({"rule": list(range(len(rules))), "cost": cost, "hits": hits, "n": [n] * len(rules)})

    rows_ = sample.select("text").mapInArrow(timed, "rule long, cost double, hits long, n long").groupBy("rule").sum("cost", "hits", "n").collect()
    by = {r[0]: r for r in rows_}
    n = max(1, max((r["sum(n)"] for r in rows_), default=1))
    return {r.name: (by[i]["sum(cost)"] / n, by[i]["sum(hits)"] / n) if i in by else (0.0, 0.0) for i, r in enumerate(rules)}


def ordered(rules: tuple[Rule, ...], measured: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """By rejections per second, most first; ties keep the given order."""
    return tuple(sorted(rules, key=lambda r: -(measured[r.name][1] / max(measured[r.name][0], 1e-9))))


def cascade(df: DataFrame, rules: tuple[Rule, ...] = RULES, sample: DataFrame | None = None, with_base: bool = False) -> DataFrame:
    """df plus `rejected_by` (the first rule in cascade order that fails, null if kept) and, on request, the base measures.

    Only costs and selectivities come from the sample (by default some of df's files, or df); they set the order of the rules,
    never a verdict. Each document is judged on its whole text, by no rule after the first that fails. Null text is empty
    text: no words, rejected by few_words or a rule that stands before it. Repeated rows are judged alike. An empty table
    gives an empty result. Existing columns of the added names are replaced, by Spark's rule for names.
    """
    prepare(df.sparkSession)
    plan = ordered(rules, measure(some_files(df) if sample is None else sample, rules, given=BASE if with_base else ()))
    added = (*BASE, "rejected_by") if with_base else ("rejected_by",)
    kept = df.drop(*added)
    place = column_place(kept, "text")
    names = [f"_{i}" for i in range(len(kept.columns))]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[str | None] = []
            base: list[list[int]] = [[] for _ in BASE]
            for x in b.column(place).cast(pa.binary()).to_pylist():
                d = Document(x or b"")
                if with_base:
                    for out, name in zip(base, BASE, strict=True):
                        out.append(getattr(d, name))
                found.append(next((r.name for r in plan if r.fails(d)), None))
            more = [pa.array(out, pa.int64()) for out in base] if with_base else []
            yield pa.RecordBatch.from_arrays([*b.columns, *more, pa.array(found, pa.string())], [*names, *added])

    return mapped(kept, judge, with_columns(kept, **{x: "string" if x == "rejected_by" else "long" for x in added}))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cascade(table(spark, sf_dir, "documents").select("doc_id", "text"), with_base=True)
    return out.selectExpr("doc_id", *BASE, "n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed", "rejected_by IS NULL AS kept")


OP3_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM lines WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
  length(t) - length(replace(t, chr(10), '')) + 1 AS n_lines, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
  len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_lettered, len(list_distinct(ws)) AS n_distinct
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id)),
v AS (SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, word_chars > 12 * n_words OR word_chars < 2 * n_words AS f3,
  10 * n_symbols > 3 * n_words AS f4, 2 * n_dup_lines > n_lines AS f5,
  10 * len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) > 9 * len(ls) AS f6, 10 * len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 3 * len(ls) AS f7,
  2 * n_lettered < n_words AS f8, 100 * n_distinct < n_words AS f9 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, NOT (f1 OR f2 OR f3 OR f4 OR f5 OR f6 OR f7 OR f8 OR f9) AS kept FROM v
"""
