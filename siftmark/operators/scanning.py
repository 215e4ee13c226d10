"""The whole scan: files against a library of rules, fingerprints and labels; one result a file."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, literals
from ..functions.fixed import LABEL_HINTS, SAMPLE_HIT
from ..sources import extract
from . import match, search, words

RULE = "rule_id string, rule_name string, sensitive_type string, risk_level string"
HITS = {
    "regex": f"array<struct<ord int, {RULE}, pattern string, match_count int, matches array<string>>>",
    "keyword": f"array<struct<ord int, {RULE}, keywords_matched array<string>>>",
    "combined": f"array<struct<ord int, {RULE}>>",
}


@dataclass
class Library:
    """What a scanning host holds. rules: dicts with rule_id, rule_type, sensitive_type, risk_level and content, in the order that counts.

    fingerprints: sensitive_file_id, sha256, simhash. labels: sensitive_file_id, semantic_labels, embedding_id.
    """

    rules: list[dict]
    fingerprints: DataFrame
    labels: DataFrame | None = None
    threshold: int = 3
    hints: dict[str, list[str]] = field(default_factory=dict)


def rule_list(rules: DataFrame) -> list[dict]:
    """Live rules as dicts, in the order of version and rule_ord; content is parsed. The driver holds the library, as a scanning host does."""
    return [{**r.asDict(), "content": json.loads(r.content)} for r in rules.orderBy("version", "rule_ord", "rule_id").collect()]


def constant(values: list, schema: str) -> Column:
    """Data as one literal, folded once whatever its size, where a Column for each value would make a plan of that size."""
    return F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), schema)


#: A library with more distinct words than this looks them up in a table of their bytes, in one pass over each text.
MANY = 256


def word_lists(rules: list[dict], labels: dict[str, list[str]]) -> dict[str, tuple[list[str], int]]:
    """By name, the lists of words that a library asks for, and how many of a list a text must hold."""
    out = {f"rule {i}": (list(dict.fromkeys(r["content"]["keywords"])), max(1, r["content"].get("min_hits", 1))) for i, r in enumerate(rules) if r["rule_type"] == "keyword" and r["content"].get("keywords")}
    for r in rules:
        for x in r["content"].get("conditions", []) if r["rule_type"] == "combined" else []:
            if x.get("type") == "keyword" and x["value"]:
                out[condition(x)] = (x["value"], max(1, x.get("min_hits", 1)))
    return out | {f"label {k}": (v, 1) for k, v in labels.items()}


def condition(x: dict) -> str:
    return f"condition {json.dumps([x['value'], x.get('min_hits', 1)], ensure_ascii=False)}"


def compiled(text: Column, folded: Column, rules: list[dict], dialect: str, bad: dict[str, str], numbers: dict[str, int] | None = None) -> dict[str, Column]:
    """By kind, the rules that match, as an array in rule order; those with a bad pattern or without words never do.

    Each distinct pattern is evaluated once and each distinct word once, however many rules have it; the rules themselves are
    constant data that the indices of what has matched select. A pattern runs only over texts whose folded form has a literal
    that it needs. numbers: of the word_lists(), where the columns held and hit
    already tell which words and lists the text holds.
    """
    named = [(i, r, {"ord": i, "rule_id": r["rule_id"], "rule_name": r["content"].get("name", "" if r["rule_type"] == "regex" else r["rule_id"]), "sensitive_type": r["sensitive_type"], "risk_level": r["risk_level"]}) for i, r in enumerate(rules)]
    by_pattern: dict[tuple[str, bool], list[dict]] = {}
    for _, r, head in named:
        if r["rule_type"] == "regex" and r["content"].get("pattern") and r["content"]["pattern"] not in bad:
            by_pattern.setdefault((r["content"]["pattern"], head["rule_name"] == "bank_card"), []).append({**head, "pattern": r["content"]["pattern"]})
    none = F.array().cast("array<string>")
    lists_ = F.array(*[match.gated(match.matches(text, p, dialect, card), folded, p, dialect, none) for p, card in by_pattern]) if by_pattern else F.array().cast("array<array<string>>")
    groups = constant(list(by_pattern.values()), f"array<array<struct<ord int, {RULE}, pattern string>>>")
    hit = F.transform(F.filter(F.transform(lists_, lambda m, i: F.struct(m.alias("m"), i.alias("i"))), lambda c: F.size(c.m) > 0), lambda c: F.struct(F.size(c.m).alias("n"), F.transform(c.m, match.masked).alias("m"), c.i.alias("i")))
    fields = ("ord", "rule_id", "rule_name", "sensitive_type", "risk_level")
    regex = F.flatten(F.transform(hit, lambda c: F.transform(F.get(groups, c.i), lambda r: F.struct(*[r[f].alias(f) for f in fields], r.pattern.alias("pattern"), c.n.alias("match_count"), c.m.alias("matches")))))

    keyword = [({**head, "words": r["content"]["keywords"], "least": max(1, r["content"].get("min_hits", 1))}) for _, r, head in named if r["rule_type"] == "keyword" and r["content"].get("keywords")]
    conditions = [(head, r["content"]) for _, r, head in named if r["rule_type"] == "combined"]
    words = list(dict.fromkeys(w for k in keyword for w in k["words"]))
    held = F.col("held") if numbers is not None else F.filter(constant(words, "array<string>"), lambda w: F.contains(text, w)) if words else F.array().cast("array<string>")
    own = lambda r: F.array_intersect(r.words, held)
    lists = constant(keyword, f"array<struct<ord int, {RULE}, words array<string>, least int>>")
    if numbers is not None:  # only the rules whose list is hit are looked at
        of_list = {numbers[f"rule {k['ord']}"]: i for i, k in enumerate(keyword)}
        place = constant([of_list.get(n, -1) for n in range(len(numbers))], "array<int>")
        lists = F.transform(F.filter(F.transform("hit", lambda n: F.get(place, n)), lambda i: i >= 0), lambda i: F.get(lists, i)) if keyword else lists
    found = F.transform(lists, lambda r: F.struct(*[r[f].alias(f) for f in fields], own(r).alias("keywords_matched"), r.least.alias("least"))) if keyword else None
    by_words = F.transform(F.filter(found, lambda r: F.size(r.keywords_matched) >= r.least), lambda r: F.struct(*[r[f].alias(f) for f in (*fields, "keywords_matched")])) if keyword else F.array().cast(HITS["keyword"])

    by_condition: dict[str, list[dict]] = {}
    for head, c in conditions:
        by_condition.setdefault(json.dumps([c.get("conditions", []), c.get("logic", "AND")], ensure_ascii=False, sort_keys=True), []).append(head)
    holds = []
    for key in by_condition:
        parts, logic = json.loads(key)
        of = lambda x: ("holds", F.array_contains("hit", numbers[condition(x)])) if numbers is not None and x["value"] else ("keyword", x["value"], x.get("min_hits", 1))
        holds.append(match.combined_match(text, [of(x) if x.get("type") == "keyword" else ("regex", x["value"]) if x.get("type") == "regex" and x["value"] not in bad else ("never",) for x in parts], logic, dialect, folded))
    groups2 = constant(list(by_condition.values()), f"array<array<struct<ord int, {RULE}>>>")
    true = F.filter(F.transform(F.array(*holds), lambda on, i: F.when(on, i)), lambda i: i.isNotNull()) if holds else F.array().cast("array<int>")
    combined = F.flatten(F.transform(true, lambda i: F.get(groups2, i))) if holds else F.array().cast(HITS["combined"])
    return {"regex": F.array_sort(regex.cast(HITS["regex"])), "keyword": F.array_sort(by_words.cast(HITS["keyword"])), "combined": F.array_sort(combined.cast(HITS["combined"]))}


def patterns(rules: list[dict]) -> list[str]:
    own = [r["content"]["pattern"] for r in rules if r["rule_type"] == "regex" and r["content"].get("pattern")]
    return own + [x["value"] for r in rules if r["rule_type"] == "combined" for x in r["content"].get("conditions", []) if x.get("type") == "regex"]


LABEL_HIT = "array<struct<sensitive_file_id string, semantic_label string, n_samples bigint>>"


def label_matches(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(path, label_hits): of each label that a file holds, how many samples bear it and the first of them; the first sample's label leads."""
    samples = labels.select("sensitive_file_id", F.explode(F.array_distinct("semantic_labels")).alias("semantic_label")).distinct()
    per_label = samples.groupBy("semantic_label").agg(F.min("sensitive_file_id").alias("sensitive_file_id"), F.count("*").alias("n_samples"))
    mine = found.select("path", F.explode("labels_held").alias("semantic_label")).join(per_label, "semantic_label")
    return mine.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("sensitive_file_id", "semantic_label", "n_samples"))).alias("label_hits"))


#: Hashes of samples that are sent to all tasks; those of a larger library are joined to results, which have no contents.
MOST_HASHES = 100_000


def scan_files(files: DataFrame, library: Library, dialect: str = "re2", pdf="installed", models: dict | None = None) -> DataFrame:
    """files (path, content) to results. Archives count by their members, and a file equal to a sample is not read further.

    A file or member that can't be read is a result with the reason, and ends nothing else. Contents stay in their partitions:
    up to MOST_HASHES of the samples' hashes go to all tasks, where a known file is not even opened. A larger library meets the
    results of the scan, by hash, and a known file's result is then that of the sample alone. models: of encodings.
    """
    opened = extract.expand(files).withColumn("sha256", F.sha2("content", 256))
    first = library.fingerprints.groupBy("sha256").agg(F.min("sensitive_file_id").alias("sha_id"))
    few = first.limit(MOST_HASHES + 1).count() <= MOST_HASHES
    known = opened.join(F.broadcast(first), "sha256", "left") if few else opened.withColumn("sha_id", F.lit(None).cast("string"))
    read = extract.file_texts(known.withColumn("sha_hit", F.col("sha_id").isNotNull()), "sha_hit", pdf, models)
    return results(read, library, dialect, None if few else first)


def scan_texts(texts: DataFrame, library: Library, dialect: str = "re2") -> DataFrame:
    """texts (path, text) to results, as scan_files(); null text is empty and equals no sample."""
    first = library.fingerprints.groupBy("sha256").agg(F.min("sensitive_file_id").alias("sha_id"))
    known = spread(texts.select("path", "text")).withColumn("sha256", F.sha2("text", 256)).join(first, "sha256", "left")
    return results(known.withColumns({"sha_hit": F.col("sha_id").isNotNull(), "skip_reason": F.lit(None).cast("string"), "extract_error": F.lit(None).cast("string")}), library, dialect)


def spread(texts: DataFrame) -> DataFrame:
    """Texts over all cores, where one file gives fewer tasks than there are; a large table stays as it lies."""
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(cores) if len(texts.inputFiles()) * 2 <= cores else texts


def results(named: DataFrame, library: Library, dialect: str, later: DataFrame | None = None) -> DataFrame:
    """(path, file_hash, sensitive, sensitive_type, risk_level, sensitive_file_id, match_score, confidence_level, match_detail) by path.

    match_detail is JSON of the rules that matched with their patterns, counts and matches, of which only the first and last
    character of longer ones are shown, the labels and
    embedding id of the sample that answers, why a file was skipped, and the patterns that were refused. The id is that of the
    nearest fingerprint, else of the first labelled sample; equal distances go to the smaller id. later: the samples' ids by
    hash (sha256, sha_id), where named does not have them yet.
    """
    spark = named.sparkSession
    bad = match.dialect.check(spark, patterns(library.rules), dialect)
    named = named.withColumn("searched", F.when(~F.col("sha_hit"), F.coalesce("text", F.lit(""))).otherwise("")).drop("text")
    t = F.col("searched")
    hints = library.hints or LABEL_HINTS
    all_labels: list[str] = []
    if library.labels is not None:
        all_labels = [r[0] for r in library.labels.select(F.explode("semantic_labels").alias("x")).distinct().orderBy("x").collect()]
    asked = word_lists(library.rules, {x: [*hints.get(x, []), x] for x in all_labels})
    all_words, numbers = {w for ws, _ in asked.values() for w in ws}, None
    if len(all_words) > MANY:
        numbers = {k: i for i, k in enumerate(asked)}
        named = words.sent(named, list(all_words), "searched", "held", list(asked.values()), "hit")
        of_label = constant([x.removeprefix("label ") if x.startswith("label ") else None for x in asked], "array<string>")
        labels_held = F.array_compact(F.transform("hit", lambda n: F.get(of_label, n)))
    else:
        labels_held = match.label_hits(t, all_labels, hints)
    rules = compiled(F.col("searched"), F.col("folded"), library.rules, dialect, bad, numbers)
    named = named.withColumn("folded", literals.folded(F.col("searched")))
    found = named.select(
        "path", "sha256", "sha_id", "sha_hit", "skip_reason", "extract_error", F.when(F.length(t) > 0, hashing.simhash(t)).alias("simhash"),
        *[c.alias(k) for k, c in rules.items()], labels_held.alias("labels_held"),
    )
    if later is not None:  # what else a known file holds does not count
        found = found.drop("sha_id", "sha_hit").join(later, "sha256", "left").withColumn("sha_hit", F.col("sha_id").isNotNull())
        keep = {"skip_reason": None, "extract_error": None, "simhash": None} | {k: F.array().cast(v) for k, v in HITS.items()} | {"labels_held": F.array().cast("array<string>")}
        found = found.withColumns({c: F.when(F.col("sha_hit"), F.lit(None) if x is None else x).otherwise(F.col(c)) for c, x in keep.items()})
    found = match.materialise(found)  # small rows without texts, read below more than once
    prints = library.fingerprints.select(F.col("sensitive_file_id").alias("sample_id"), hashing.simhash_bits(F.col("simhash")).alias("bits")).where("bits IS NOT NULL")
    bits = found.where("simhash IS NOT NULL").select(F.concat(F.lit("\x00"), "path").alias("doc_id"), hashing.simhash_bits(F.col("simhash")).alias("bits"))
    near = search.near_by_hamming(bits, prints, library.threshold).select(F.substring("doc_id", 2, 1 << 30).alias("path"), F.col("sample_id").alias("near_id"))
    none = F.array().cast(LABEL_HIT)
    joined = found.join(near, "path", "left")
    joined = joined.join(label_matches(found, library.labels), "path", "left") if library.labels is not None else joined.withColumn("label_hits", none)
    count = lambda name, levels, inside: F.size(F.filter(name, lambda h: h.risk_level.isin(*levels) if inside else ~h.risk_level.isin(*levels)))
    grave = ("high", "critical")
    labels = F.coalesce("label_hits", none)
    borne = F.aggregate(labels, F.lit(0).cast("bigint"), lambda n, h: n + h.n_samples)
    value = match.score(F.col("sha_hit"), F.col("near_id").isNotNull(), count("regex", grave, True), count("regex", grave, False), F.size("keyword"), F.size("combined"), borne)
    answers = F.coalesce("sha_id", "near_id", F.get("label_hits", F.lit(0)).sensitive_file_id)
    scored = joined.withColumn("label_hits", labels).withColumns({"match_score": value, "answers": answers})
    told = F.array().cast("array<string>")
    if library.labels is not None:
        of = library.labels.groupBy(F.col("sensitive_file_id").alias("answers")).agg(F.min_by(F.struct("semantic_labels", "embedding_id"), F.coalesce("embedding_id", F.lit(""))).alias("of"))
        scored = scored.join(of, "answers", "left").withColumns({"told_labels": F.coalesce("of.semantic_labels", told), "told_id": F.col("of.embedding_id")})
    else:
        scored = scored.withColumns({"told_labels": told, "told_id": F.lit(None).cast("string")})
    type_ = F.coalesce(*[F.get(k, F.lit(0)).sensitive_type for k in ("keyword", "combined", "regex")], F.get("label_hits", F.lit(0)).semantic_label)
    shown = lambda k: F.transform(k, lambda h: h.dropFields("ord", "sensitive_type")).alias(f"{k}_hits")
    detail = F.to_json(
        F.struct(
            F.col("sha_hit").alias("sha256_hit"), F.col("near_id").isNotNull().alias("simhash_hit"), "simhash", shown("regex"), shown("keyword"), shown("combined"), F.col("label_hits").alias("semantic_label_hits"),
            F.col("told_labels").alias("semantic_labels"), F.col("told_id").alias("embedding_id"), "skip_reason", "extract_error", F.lit("; ".join(f"{p}: {e}" for p, e in bad.items()) or None).cast("string").alias("refused_patterns"),
        )
    )
    return scored.select(
        "path", F.col("sha256").alias("file_hash"), (F.col("match_score") >= 80).alias("sensitive"), F.when(F.col("sha_hit"), SAMPLE_HIT).otherwise(type_).alias("sensitive_type"), match.risk(F.col("match_score")).alias("risk_level"),
        F.col("answers").alias("sensitive_file_id"), "match_score", match.confidence(F.col("match_score")).alias("confidence_level"), detail.alias("match_detail"),
    )


def summary(results: DataFrame) -> DataFrame:
    """One row of counts."""
    level = F.col("confidence_level")
    return results.agg(F.count("*").alias("total"), *[F.count_if(level == x).alias(x) for x in ("sensitive", "suspected", "low_confidence")])
