"""Many words at once, literal gates, and the scan of a large library."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftmark.functions import fixed, literals
from siftmark.functions.hashing import simhash
from siftmark.operators import match, scanning, words

letters = st.text("ab é一😀 \n", max_size=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(letters, max_size=30), st.lists(st.text("ab é一😀 \n", max_size=60), max_size=8))
def test_words_as_contains(ws, texts):
    table = words.Words(ws)
    which, word = table.find([t.encode() for t in texts])
    got = [(int(a), table.words[b]) for a, b in zip(which, word)]
    assert got == sorted((i, w) for i, t in enumerate(texts) for w in set(ws) if w and w in t)


def test_long_words_that_share_most_of_their_bytes():
    ws = ["https://example.org/a/very/long/path/" + str(i) for i in range(3000)] + ["x" * n for n in range(1, 40)]
    table = words.Words(ws)
    text = "see https://example.org/a/very/long/path/77 and xxxxxxxxxxxx"
    which, word = table.find([b"", text.encode(), b"x"])
    assert {(int(a), table.words[b]) for a, b in zip(which, word)} == {(1, w) for w in ws if w in text} | {(2, "x")}


@pytest.mark.parametrize("most", [words.MOST_BYTES, 0])
def test_words_sent_and_joined(spark, most):
    rows = [(1, "Foo bar, a longer sentence with foo"), (2, None), (3, ""), (4, "a" * 500 + " longer sent"), (5, "é一😀? b"), (6, "Foo bar"), (7, "\U0001f600b")]
    texts = spark.createDataFrame([(*r, "kept") for r in rows], "`k y` long, text string, other string").withColumnRenamed("k y", "k")
    ws = ["foo", "Foo", "longer sentence", "a", "", None, "é一😀", "aaaaaaaaaaaaaaaaaaaa", "zzz", "?b", "sent", "😀b", "bar", "\n"]
    df = spark.createDataFrame([(w,) for w in [*ws, *ws]], "word string")
    got = {r.k: sorted(r.held) for r in words.with_words(texts, df, "k", most=most).collect()}
    assert got == {k: sorted({w for w in ws if w and t and w in t}) for k, t in rows}
    assert words.with_words(texts, df.where("false"), "k", most=most).where("size(held) > 0").count() == 0
    assert words.with_words(texts.where("false"), df, "k", most=most).count() == 0


def test_words_in_files_equal_words_sent(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    urls = [(f"https://example.org/a/path/{i}{'/x' * (i % 30)}",) for i in range(500)]
    own = docs.select(F.explode(F.split("text", " ")).alias("word")).where("word != ''").unionByName(spark.createDataFrame(urls, "word string"))
    texts = docs.unionByName(spark.createDataFrame([(-1, " ".join(u for (u,) in urls[::7])), (-2, None)], docs.schema))
    plain = {r.doc_id: r.held for r in words.with_words(texts, own, "doc_id", most=1 << 30).collect()}
    monkeypatch.setattr(words, "STEP", 5000)
    monkeypatch.setattr(words, "SHARD", 3000)
    assert {r.doc_id: r.held for r in words.with_words(texts, own, "doc_id", most=0).collect()} == plain


def test_a_library_of_megabytes_stays_away_from_the_driver(spark, monkeypatch):
    own = spark.range(500_000).selectExpr("concat('word-', id) AS word")
    monkeypatch.setattr(words, "sent", lambda *_: pytest.fail("sent"))
    texts = spark.createDataFrame([(1, "a word-499999 b"), (2, "word-x")], "k long, text string")
    got = {r.k: r.held for r in words.with_words(texts, own, "k").collect()}
    assert got == {1: ["word-4", "word-49", "word-499", "word-4999", "word-49999", "word-499999"], 2: []}


piece = st.recursive(
    st.sampled_from(["a", "b", "K", "s", "1", "[ab]", "[a-c]", r"\d", ".", r"\.", "x-", "[_-]", "客", r"\b", "^", "$", r"\w", "[^a]", "i"]),
    lambda x: st.one_of(st.lists(x, min_size=1, max_size=4).map("".join), st.lists(x, min_size=1, max_size=3).map(lambda v: f"({'|'.join(v)})"), x.map(lambda v: f"(?:{v})?"), x.map(lambda v: f"(?:{v}){{1,2}}"), x.map(lambda v: f"(?i:{v})"), x.map(lambda v: f"(?:{v})*"), x.map(lambda v: f"(?:{v})+"), x.map(lambda v: f"(?={v})")),
    max_leaves=12,
)


@settings(max_examples=600, deadline=None)
@given(piece, st.booleans(), st.lists(st.text("abcKkSsſKiIİ1._x-客 \n", max_size=14), max_size=12))
def test_gates_lose_nothing(pattern, fold, texts):
    pattern = "(?i)" * fold + pattern
    need = literals.required(pattern, "python")
    for t in texts:
        if need and re.search(pattern, t):
            low = t.translate(str.maketrans(*literals.FOLDED)).lower()
            assert any(x in low for x in need), (pattern, t, need)


def test_gates_of_known_patterns():
    need = {n: literals.required(p) for n, p, _ in fixed.BUILTIN_RULES}
    assert need["email"] == ["@"] and "api_key" in need["api_key"] and need["money_wan"] == ["万元"] and need["credit_code"] is None
    assert literals.required("(a|)b*") is None and literals.required("(?x)a b", "python") is None and literals.required("a(b") is None
    assert literals.required(r"\Qa.b\E+c") == ["a.b"] and literals.required("[[:alpha:]]]") is not None


def test_gated_counts_equal_plain_ones(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "APIKey: paſſword = ABCDEFGH12345678901 社保 123456789012"), (-2, None), (-3, "PAſſWORD=hunter22 K"), (-4, "-----BEGIN PRIVATE KEY-----")], "doc_id long, text string"))
    rules = [*fixed.BUILTIN_RULES, ("word", r"(?i)licen[sc]e|pa(ss|zz)word", "low"), ("bad", "a(b", "low")]
    plain = df.select("doc_id", F.inline(F.array(*[F.struct(F.lit(n).alias("rule_name"), F.size(match.matches(F.col("text"), p, "re2", n == "bank_card")).alias("n")) for n, p, _ in rules if n != "bad"]))).where("n > 0")
    got = match.content_scan(df, "doc_id", rules=rules)
    assert Counter(tuple(r) for r in plain.collect()) == Counter((r.doc_id, r.rule_name, r.match_count) for r in got.collect())


def test_a_scan_with_many_words_equals_one_with_few(spark, sf_dir, monkeypatch):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), "text")
    some = [r[0] for r in texts.select(F.explode(F.split("text", " "))).distinct().orderBy("col").limit(400).collect() if r[0]]
    keyword = [{"rule_id": f"k{i}", "rule_type": "keyword", "sensitive_type": "words", "risk_level": "low", "content": {"keywords": some[i : i + 9] + some[i : i + 1], "min_hits": 1 + i % 3}} for i in range(0, 60, 5)]
    both = [{"rule_id": f"c{i}", "rule_type": "combined", "sensitive_type": "both", "risk_level": "high", "content": {"logic": "AND", "conditions": [{"type": "keyword", "value": some[i : i + 30], "min_hits": 2}, {"type": "regex", "value": "[A-Z][a-z]+"}]}} for i in range(0, 90, 30)]
    prints = texts.limit(1).select(F.col("path").alias("sensitive_file_id"), F.sha2("text", 256).alias("sha256"), simhash("text").alias("simhash"))
    labels = spark.createDataFrame([("s1", ["the", "x"], "e1"), ("s0", ["x"], "e0")], "sensitive_file_id string, semantic_labels array<string>, embedding_id string")
    lib = scanning.Library([*keyword, *both, {"rule_id": "none", "rule_type": "keyword", "sensitive_type": "", "risk_level": "low", "content": {"keywords": []}}], prints, labels, hints={"x": some[:20]})
    plain = Counter(tuple(r) for r in scanning.scan_texts(texts, lib).collect())
    monkeypatch.setattr(scanning, "MANY", 0)
    assert Counter(tuple(r) for r in scanning.scan_texts(texts, lib).collect()) == plain
