"""From samples to rules: regex, keyword and combined rules, labels, embedding ids, and the replies of optional models.

Everything is Columns over the samples; a list of patterns, terms or templates is compiled into the plan.
"""

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import literals
from ..functions.dialect import to_java
from ..functions.fixed import BUILTIN_RULES, BUSINESS_TERMS, EXPLANATION, HIGH_RISK_LABELS, KEYWORD_RULE, LABEL_HINTS, PLACEHOLDER, PROMPT, RISKS, STOP_WORDS, TEMPLATES, UNCLASSIFIED
from . import segment
from .match import gated, infer_labels, matches

KINDS = ("regex", "keyword", "combined")


def filled(value: Column, default: str) -> Column:
    """The default for null and empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def higher_risk(a: Column, b: Column) -> Column:
    """The second where it stands higher; unknown levels stand lowest, with `info`."""
    place = lambda c: F.greatest(F.lit(1), F.array_position(F.array(*map(F.lit, RISKS)), c))
    return F.when(place(b) > place(a), b).otherwise(a)


def meaningful(word: Column, stop_words=STOP_WORDS) -> Column:
    return F.length(word).between(2, 32) & ~word.rlike(r"^\p{Nd}+$") & ~F.lower(word).isin(*stop_words)


def keywords(samples: DataFrame, key: str, text: str = "text", kind: str = "sensitive_type", description: str = "description", terms=BUSINESS_TERMS, stop_words=STOP_WORDS, top: int = 12, dictionary: dict[str, int] | None = None) -> DataFrame:
    """(key, word, score, place): a point an occurrence in text, type and description; a contained term 80, 30 more in the type, 40 in the description.

    Terms are found without regard to case; equal scores are ordered by word. Null columns are empty. Keys are unique.
    dictionary: from segment.learned(); with one, runs of Chinese characters are cut into words, and a sample's 30 best words
    by TF-IDF get 60 points, 59 and so on.
    """
    t, k, d = (F.coalesce(F.col(c), F.lit("")) for c in (text, kind, description))
    whole = F.concat_ws(" ", t, k, d)

    def worth(x: Column) -> Column:
        held = lambda where, n: F.when(F.contains(F.lower(where), F.lower(x)), F.lit(n)).otherwise(F.lit(0))
        return F.struct(x.alias("word"), (held(whole, 80) + held(k, 30) + held(d, 40)).cast("long").alias("score"))

    found = F.filter(F.transform(F.array(*map(F.lit, terms)), worth), lambda s: s.score > 0) if terms else F.array().cast("array<struct<word string, score bigint>>")
    points = lambda words: F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(1).cast("long").alias("score")))
    runs = lambda p: F.regexp_extract_all(whole, F.lit(p), F.lit(0))
    near = samples.select(*dict.fromkeys((key, text, kind, description))).repartition(key)  # words are counted and ranked where their sample lies
    if dictionary is None:
        each = near.select(key, F.inline(F.concat(points(runs(r"[\p{L}\p{Nd}]+")), found)))
        own = each.where(meaningful(F.col("word"), stop_words))
    else:
        cut = segment.segmented(near.select(key, runs(segment.HAN).alias("runs"), runs(r"[\p{L}\p{Nd}&&[^\p{IsHan}]]+").alias("others")), "runs", dictionary)
        kept = cut.select(key, F.filter(F.concat("cut", "others"), lambda w: meaningful(w, stop_words)).alias("words"))
        each = kept.select(key, F.inline(points(F.col("words"))))
        held = samples.select(key, F.inline(found)).where(meaningful(F.col("word"), stop_words))
        own = each.unionByName(segment.best_words(kept, key, "words").withColumnRenamed("points", "score")).unionByName(held)
    both = own.groupBy(key, "word").agg(F.sum("score").alias("score"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "word"))
    return both.select("*", place.alias("place")).where(F.col("place") <= top)


def rules(samples: DataFrame, key: str, text: str = "text", kind: str = "sensitive_type", risk: str = "risk_level", description: str = "description", terms=BUSINESS_TERMS, stop_words=STOP_WORDS, templates=TEMPLATES, dialect: str = "re2") -> DataFrame:
    """(key, place, rule_name, rule_type, sensitive_type, risk_level, content): what each sample gives, in the order regex, keyword, combined.

    content is JSON. A regex rule for each builtin pattern that the text matches, one keyword rule of the best words, and a
    combined rule for each template with a trigger in text, description or type. Null columns are empty.
    """
    t, d = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(description), F.lit(""))
    type_, level = filled(F.col(kind), UNCLASSIFIED), filled(F.col(risk), "medium")
    row = lambda place, name, how, risk_, content, when: F.when(when, F.struct(F.lit(place).alias("place"), name.alias("rule_name"), F.lit(how).alias("rule_type"), type_.alias("sensitive_type"), risk_.alias("risk_level"), content.alias("content")))
    text_of = lambda **x: F.lit(json.dumps(x, ensure_ascii=False))
    folded = F.col("_folded")
    held = lambda p, card: gated(F.size(matches(t, p, dialect, True)) > 0 if card else F.regexp_like(t, F.lit(to_java(p, dialect))), folded, p, dialect, F.lit(False))
    made = [row(i, F.lit(n), "regex", higher_risk(level, F.lit(r)), text_of(name=n, pattern=p), held(p, n == "bank_card")) for i, (n, p, r) in enumerate(BUILTIN_RULES)]
    for i, (n, words, least, pattern, r, triggers) in enumerate(templates):
        content = text_of(logic="AND", conditions=[{"type": "keyword", "value": words, "min_hits": least}, {"type": "regex", "value": pattern}])
        seen = F.exists(F.array(*map(F.lit, triggers)), lambda w: F.contains(t, w) | F.contains(d, w) | F.contains(type_, w))
        made.append(row(len(BUILTIN_RULES) + 1 + i, F.lit(n), "combined", higher_risk(level, F.lit(r)), content, seen))
    out = samples.withColumn("_folded", literals.folded(t)).select(key, F.inline(F.array_compact(F.array(*made))))
    named = samples.select(key, text, type_.alias("_type"), level.alias("_risk"), description)
    best = keywords(named, key, text, "_type", description, terms, stop_words)
    words = best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda s: s.word).alias("_words"))  # at most `top` words
    content = F.to_json(F.struct(F.col("_words").alias("keywords"), F.lit("any").alias("match_mode"), F.when(F.size("_words") == 1, 1).otherwise(2).alias("min_hits")))
    by_words = named.drop(text, description).join(words, key).select(
        key, F.lit(len(BUILTIN_RULES)).alias("place"), F.concat("_type", F.lit(KEYWORD_RULE)).alias("rule_name"), F.lit("keyword").alias("rule_type"), F.col("_type").alias("sensitive_type"), F.col("_risk").alias("risk_level"), content.alias("content")
    )
    return out.unionByName(by_words)


def infer_risk(labels: Column) -> Column:
    return F.when(F.arrays_overlap(labels, F.array(*map(F.lit, HIGH_RISK_LABELS))), "high").when(F.size(labels) > 0, "medium").otherwise("low")


def analyse(text: Column, kind: Column, risk: Column, hints: dict[str, list[str]] = LABEL_HINTS) -> Column:
    """A struct of semantic_labels, sensitive_type, risk_level, model_name and explanation, by rules only; labels stand in declared order."""
    text, kind = F.coalesce(text, F.lit("")), F.coalesce(kind, F.lit(""))
    labels = infer_labels(F.concat(text, F.lit(" "), kind), hints)
    type_ = F.when(kind != "", kind).when(F.size(labels) > 0, F.array_join(labels, "/")).otherwise(UNCLASSIFIED)
    shown = F.when(F.size(labels) > 0, labels).otherwise(F.array(type_))
    told = F.concat(F.lit(EXPLANATION[0]), F.array_join(shown, "/"), F.lit(EXPLANATION[1]))
    return F.struct(shown.alias("semantic_labels"), type_.alias("sensitive_type"), F.coalesce(F.nullif(risk, F.lit("")), infer_risk(labels)).alias("risk_level"), F.lit("rule-fallback").alias("model_name"), told.alias("explanation"))


def prompt(text: Column, kind: Column, risk: Column, most: int = 4000) -> Column:
    """The model's prompt; the text goes in last, so that marks inside it stay as they are."""
    out = F.lit(PROMPT)
    for mark, value in (("{{SENSITIVE_TYPE}}", kind), ("{{RISK_LEVEL}}", risk), ("{{DOCUMENT_TEXT}}", F.substring(text, 1, most))):
        out = F.replace(out, F.lit(mark), F.coalesce(value, F.lit("")))
    return out


def parse_reply(reply: Column, kind: Column, risk: Column) -> Column:
    """A model's JSON reply, with or without a code fence, as the struct of analyse() without a model's name; null where it is no JSON."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```(?:json)?", ""), r"```$", ""))
    got = F.from_json(bare, "semantic_labels array<string>, sensitive_type string, risk_level string, explanation string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    type_ = F.coalesce(F.nullif(got.sensitive_type, F.lit("")), F.nullif(kind, F.lit("")), F.lit(UNCLASSIFIED))
    labels = F.when(F.size(got.semantic_labels) > 0, got.semantic_labels).otherwise(F.array(type_))
    made = F.struct(labels.alias("semantic_labels"), type_.alias("sensitive_type"), F.coalesce(F.nullif(got.risk_level, F.lit("")), F.nullif(risk, F.lit("")), F.lit("medium")).alias("risk_level"), F.coalesce(got.explanation, F.lit("")).alias("explanation"))
    return F.when(got.isNotNull() & got["_bad"].isNull(), made)


def embedding_id(model: Column, text: Column) -> Column:
    """Over the whole text, not the part that a model sees."""
    return F.concat(F.lit("emb_"), F.substring(F.sha2(F.concat(model, F.lit("\x00"), text), 256), 1, 16))


def placeholder(text: Column, name: Column, size: Column) -> Column:
    """Stands for the text of a sample that has none."""
    return F.coalesce(F.nullif(text, F.lit("")), F.format_string(PLACEHOLDER, name, size))
