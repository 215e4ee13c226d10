"""The trie against dictionaries, and the query against a plain computation."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftmark.llm import language_model as lm
from siftmark.llm.common import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), "\n"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=300))
def test_monotone(values):
    v = np.sort(np.array(values, np.int64))
    m = lm.Monotone(lm.Monotone.layout(v))
    assert (m.at(np.arange(len(v))) == v).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=1, max_size=300))
def test_neighbours_of_a_monotone_sequence(steps):
    v = np.cumsum(np.array(steps, np.int64))
    at = np.arange(len(v) - 1)
    low, high = lm.Monotone(lm.Monotone.layout(v)).pair(at)
    assert (low == v[:-1]).all() and (high == v[1:]).all()


def test_codes_are_close():
    v = np.random.default_rng(0).random(5000) + 1e-9
    got = lm.BOOK[lm.unpacked(lm.windows(lm.coded(v)), lm.CODE, np.arange(len(v)))]
    assert np.abs(np.log10(got / np.minimum(v, 1))).max() < 0.0022


class Plain:
    """The module's formulas over dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.single = Counter(t for x in texts for t in tokens(x))
        self.n, self.v = sum(self.single.values()), len(self.single)
        self.counts = {}
        for k in range(2, order + 1):
            self.counts[k] = Counter(tuple(s[i : i + k]) for s in ([None, *tokens(x)] for x in texts) for i in range(len(s) - k + 1))
        self.inside, self.kinds = Counter(), Counter()
        for c in self.counts.values():
            for g, m in c.items():
                self.inside[g[:-1]] += m
                self.kinds[g[:-1]] += 1
        self.cut = {}
        for k, c in self.counts.items():
            once, twice = sum(m == 1 for m in c.values()), sum(m == 2 for m in c.values())
            self.cut[k] = once / (once + 2 * twice) if once and twice else 0.5

    def p(self, context, w):
        p = (self.single[w] + 1) / (self.n + self.v + 1)
        for k in range(2, self.order + 1):
            h = tuple(context[len(context) - k + 1 :])
            if len(h) == k - 1 and self.kinds[h]:
                c, d = self.counts[k][(*h, w)], self.cut[k]
                p = max(c - d, 0) / self.inside[h] + d * self.kinds[h] / self.inside[h] * p
        return p

    def score(self, text):
        s = [None, *tokens(text)]
        return sum(math.log10(self.p(s[:i], s[i])) for i in range(1, len(s)))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_against_a_plain_model_for_several_partition_counts(spark, sf_dir, order):
    """Common words and the start mark are spread over shards where there are many, and not where there are few."""
    held = "crc32(encode(coalesce(cast(doc_id as string), ''), 'UTF-8')) % 7 = 2"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, "the the the of unheardof the of"), (10**6 + 1, ""), (10**6 + 2, None)], "doc_id long, text string"))
    plain = Plain([r.text for r in docs.where(f"NOT {held}").collect()], order)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in (2, 8, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            model = lm.train(docs.where(f"NOT {held}").select("text"), shared_dir(spark, "lm-test"), order)
            found.append({r.doc_id: (r.score, r.n_tokens) for r in lm.score(docs, model).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for r in docs.collect():
        score, n = found[0][r.doc_id]
        assert abs(score - plain.score(r.text)) < 0.0022 * n + 1e-6  # half a step of the codes
        assert all(math.isclose(f[r.doc_id][0], score, rel_tol=1e-12) for f in found)


def test_probabilities_sum_to_one():
    plain = Plain(["a b a c", "a b b", "", "c a b a"], 3)
    for context in ([None], [None, "a"], ["a", "b"], ["zz"], ["b", "b"], ["c", "zz"]):
        assert math.isclose(sum(plain.p(context, w) for w in ("a", "b", "c", "qqq", "\n")), 1)


def test_query(spark, tables):
    got = lm.op5_lm_scoring(spark, tables).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(t for i, x in docs if not held(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    want = defaultdict(list)
    for i, x in docs:
        want[i].append((held(i), len(tokens(x)), sum(t in c for t in tokens(x)), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x))))
    for r in got:
        assert any(w[:4] == (r.held_out, r.n_tokens, r.n_known, r.train_tokens) and math.isclose(w[4], r.base_score, rel_tol=1e-9) for w in want[r.doc_id])
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in docs)


def test_held_out_texts_are_more_likely_than_by_single_words(spark, sf_dir):
    rows = [r for r in lm.op5_lm_scoring(spark, sf_dir).collect() if r.held_out and r.n_tokens > 50]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert sum(r.score > r.base_score for r in rows) > 0.5 * len(rows)


def test_query_uses_three_words(spark, sf_dir):
    held = "crc32(encode(coalesce(cast(doc_id as string), ''), 'UTF-8')) % 7 = 2"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pairs = lm.train(docs.where(f"NOT {held}").select("text"), shared_dir(spark, "lm-test"), 2)
    of_pairs = sum(r.score for r in lm.score(docs.where(held), pairs).collect())
    rows = [r for r in lm.op5_lm_scoring(spark, sf_dir).collect() if r.held_out]
    assert sum(r.score for r in rows) > of_pairs + 0.1 * sum(r.n_tokens for r in rows)  # log10
