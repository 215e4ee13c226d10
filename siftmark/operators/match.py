"""Rule matching, scores and verdicts, all as Columns: rules are compiled into the plan, never joined to documents."""

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dialect, literals
from ..functions.dialect import check, to_java
from ..functions.fixed import BUILTIN_RULES, LABEL_HINTS
from ..functions.hashing import is_card


def matches(text: Column, pattern: str, dialect: str = "re2", card: bool = False) -> Column:
    """All full matches in order; of card numbers, those with a valid checksum."""
    found = F.regexp_extract_all(text, F.lit(to_java(pattern, dialect)), F.lit(0))
    return F.filter(found, is_card) if card else found


def gated(found: Column, folded: Column, pattern: str, dialect: str, other: Column) -> Column:
    """found where one of the literals that the pattern's matches need stands in the folded text, else other: there it is not computed."""
    may = literals.gate(folded, pattern, dialect)
    return found if may is None else F.when(may, found).otherwise(other)


def match_count(text: Column, folded: Column, pattern: str, dialect: str = "re2", card: bool = False) -> Column:
    return gated(F.size(matches(text, pattern, dialect, card)), folded, pattern, dialect, F.lit(0))


def masked(value: Column) -> Column:
    """A value's first and last character; nothing of values of one or two."""
    text = value.cast("string")
    return F.when(F.length(text) > 2, F.concat(F.substring(text, 1, 1), F.lit("***"), F.substring(text, -1, 1))).when(text.isNotNull(), F.lit("***"))


def content_scan(df: DataFrame, key: str, text: str = "text", rules=BUILTIN_RULES, dialect: str = "re2") -> DataFrame:
    """(key, rule_name, risk_level, match_count) of the rules that match; matched values stay inside, rules with a refused pattern match nothing."""
    bad = check(df.sparkSession, [p for _, p, _ in rules], dialect)
    t, folded = F.col("t"), F.col("folded")
    hits = [F.struct(F.lit(n).alias("rule_name"), F.lit(r).alias("risk_level"), match_count(t, folded, p, dialect, n == "bank_card").alias("match_count")) for n, p, r in rules if p not in bad]
    if not hits:
        hits = [F.struct(F.lit("").alias("rule_name"), F.lit("").alias("risk_level"), F.lit(0).alias("match_count"))]
    texts = df.select(F.col(key).alias("k"), F.col(text).alias("t"), literals.folded(F.col(text)).alias("folded"))
    return texts.select(F.col("k").alias(key), F.inline(F.filter(F.array(*hits), lambda h: h.match_count > 0)))


def regex_test(text: Column, pattern: str, dialect_: str = "re2") -> Column:
    """A struct of all full matches, their count and, for a pattern that the dialect refuses, the error; null text has no match."""
    try:
        found, error = F.coalesce(F.regexp_extract_all(text, F.lit(to_java(pattern, dialect_)), F.lit(0)), F.array().cast("array<string>")), F.lit(None).cast("string")
    except dialect.Refused as e:
        found, error = F.array().cast("array<string>"), F.lit(str(e))
    return F.struct(found.alias("matches"), F.size(found).alias("count"), error.alias("error"))


def keyword_hits(text: Column, words: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def keyword_match(text: Column, words: list[str], min_hits: int = 1) -> Column:
    return F.size(keyword_hits(text, words)) >= max(1, min_hits) if words else F.lit(False)


def pattern_match(text: Column, folded: Column | None, pattern: str, dialect: str = "re2") -> Column:
    found = F.regexp_like(text, F.lit(to_java(pattern, dialect)))
    return found if folded is None else gated(found, folded, pattern, dialect, F.lit(False))


def combined_match(text: Column, conditions: list[tuple], logic: str = "AND", dialect: str = "re2", folded: Column | None = None) -> Column:
    """conditions: ("keyword", words, least hits), ("regex", pattern) or ("holds", a column). Another logic or type of condition never holds."""
    parts = [keyword_match(text, c[1], c[2]) if c[0] == "keyword" else c[1] if c[0] == "holds" else pattern_match(text, folded, c[1], dialect) if c[0] == "regex" else F.lit(False) for c in conditions]
    if not parts or logic not in ("AND", "OR"):
        return F.lit(False)
    return reduce(lambda a, b: a & b if logic == "AND" else a | b, parts)


def label_hits(text: Column, labels: list[str], hints: dict[str, list[str]] = LABEL_HINTS) -> Column:
    """The labels of which a hint, or the label itself, stands in the text; case counts."""
    cases = [F.when(keyword_match(text, [*hints.get(x, []), x]), F.lit(x)) for x in labels]
    return F.array_compact(F.array(*cases)) if cases else F.array().cast("array<string>")


def infer_labels(text: Column, hints: dict[str, list[str]] = LABEL_HINTS) -> Column:
    """Labels by hints without regard to case, in declared order."""
    return label_hits(F.lower(text), list(hints), {k: [x.lower() for x in v] for k, v in hints.items()})


def score(sha: Column, near: Column, high: Column, other: Column, keyword: Column, combined: Column, semantic: Column) -> Column:
    """sha and near are booleans, the others numbers of hits."""
    points = F.when(sha, 100).otherwise(0) + F.when(near, 70).otherwise(0) + 30 * high + 15 * other + 30 * keyword + 50 * combined + F.least(F.lit(30), 20 * semantic)
    return F.least(F.lit(100), points).cast("int")


def steps(value: Column, levels: list[tuple[int, str]], rest: str) -> Column:
    out = F.lit(rest)
    for least, name in reversed(levels):
        out = F.when(value >= least, F.lit(name)).otherwise(out)
    return out


def confidence(value: Column) -> Column:
    return steps(value, [(80, "sensitive"), (50, "suspected"), (30, "low_confidence")], "clean")


def risk(value: Column) -> Column:
    return steps(value, [(80, "high"), (50, "medium"), (30, "low")], "info")


def materialise(df: DataFrame) -> DataFrame:
    """df cut from its lineage, in the shared folder spark.checkpoint.dir names; a folder is set here only where that is unset."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(base or f"file:///tmp/checkpoints/{uuid.uuid4().hex[:12]}")
    return df.checkpoint()
