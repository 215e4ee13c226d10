"""The Jaccard join and the pipeline against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftmark.llm import jaccard, quality, secrets
from siftmark.llm.common import U64, shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def plain_components(rows):
    """A list of (doc_id, size, component) in row order, from all pairs that share a shingle."""
    sets = [plain_set(t) for _, t in rows]
    over = list(range(len(rows)))

    def root(x):
        while over[x] != x:
            over[x] = x = over[over[x]]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in where[x])
        for x in s:
            where[x].append(i)
        for j, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                over[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if sets[i] and d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def all_rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def chains():
    """Chains whose ends are far apart, groups around the limit, large groups with a shared passage, and small sets."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    rows = []
    for size in (4, 5, 6, 7, 8, 9, 12, 20, 40, 130, 260, 700):
        for _ in range(6):
            text = [word() for _ in range(size)]
            for _ in range(8):
                rows.append(" ".join(text))
                text = list(text)
                for _ in range(max(1, size // 60)):
                    text[r.randrange(len(text))] = word()
                if r.random() < 0.3:
                    text.append(word())
    passage = [word() for _ in range(60)]
    for _ in range(300):
        rows.append(" ".join([word() for _ in range(r.randrange(5, 200))] + passage + [word() for _ in range(r.randrange(5, 200))]))
    base = [word() for _ in range(300)]
    for _ in range(300):
        text = list(base)
        for _ in range(r.randrange(0, 9)):
            text[r.randrange(300)] = word()
        rows.append(" ".join(text))
    r.shuffle(rows)
    return list(enumerate(rows))


def test_join_finds_every_link(spark, chains):
    df = spark.createDataFrame(chains, "doc_id long, text string").repartition(7)
    assert all_rows(jaccard.near_duplicates(df)) == Counter(plain_components(chains))


def test_join_on_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert all_rows(jaccard.op10_ngram_jaccard(spark, tables)) == Counter(plain_components(rows))


def test_one_of_each(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = jaccard.one_of_each(docs)
    assert got.columns == docs.columns
    left = [(r.doc_id, r.text) for r in got.collect()]
    empties = [x for x in rows if not plain_set(x[1])]
    assert Counter(x for x in left if not plain_set(x[1])) == Counter(empties)
    groups = plain_components(left)
    assert len([g for g, x in zip(groups, left) if plain_set(x[1])]) == len({c for (_, n, c) in plain_components(rows) if n})
    assert not Counter(left) - Counter(rows)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6), st.floats(0, 0.25))
def test_similar_sets_share_a_key_and_parity_never_overstates(n, seed, share):
    """Both promises that the join rests on, for random sets and changes up to the limit."""
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, n).astype(U64) * U64(2))
    b = a.copy()
    for _ in range(int(share * n) + 1):
        c = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 and len(b) > 1 else np.unique(np.append(b, U64(rng.integers(0, 2**63)) * U64(2)))
        both = len(np.intersect1d(a, c))
        if not jaccard.similar(both, len(a), len(c)):
            break
        b = c
    both = len(np.intersect1d(a, b))
    differ = len(a) + len(b) - 2 * both
    assert differ <= jaccard.may_differ(len(a), len(b))
    assert set(jaccard.block_keys(a)[0].tolist()) & set(jaccard.block_keys(b)[0].tolist())
    p, q = jaccard.parity(a), jaccard.parity(b)
    size = min(len(p), len(q))
    assert np.bitwise_count(jaccard.folded(p, size) ^ jaccard.folded(q, size)).sum() <= differ


def test_large_groups_are_cut_into_pairs_of_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 3)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 100).astype(U64)
    rows = []
    for i in range(20):
        s = base.copy()
        s[i % 5] = U64(i)
        rows.append((1, i, i, 20, len(s), bytearray(jaccard.parity(np.unique(s)).tobytes())))
    df = spark.createDataFrame(rows, "key long, cls long, label long, size long, n long, bits binary")
    got = {tuple(r) for r in jaccard.compared(df.select("key", "cls", "label", "size"), df.select("cls", "n", "bits"), False).collect()}
    assert got == {(i, j) for i in range(20) for j in range(i + 1, 20)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.label for r in jaccard.components(df, shared_dir(spark, "cc-test")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 140)}, 201: 200}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = [(i, t) for i, t in rows if not any(rule.fails(quality.Document((t or "").encode())) for rule in quality.RULES)]
    rows = [x for x, (d, n, c) in zip(rows, plain_components(rows)) if d == c]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {}
    for i, x in rows:
        x = x or ""
        spans = secrets.scan(x.encode())[1]
        ids[i] = t.encode(secrets.redact(x.encode(), spans) if spans else x, add_special_tokens=False).ids + [2]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(ids)
    assert all(zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert sum(r.length for r in got) == sum(map(len, ids.values()))


def test_stages_keep_the_columns(spark, odd_dir, empty_dir):
    import corpus_pipeline

    for d in (odd_dir, empty_dir):
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, d)
            assert out.dtypes == docs.dtypes
            out.collect()
        rows = corpus_pipeline.run(spark, d).collect()
        long_enough = {r.doc_id for r in docs.collect() if len((r.text or "").split()) >= 50}
        assert {r.doc_id for r in rows} <= long_enough and all(0 < r.length <= 4096 for r in rows)


def test_shingle_sets_match_plain_ones():
    for t in ("", "  ", "a", "A b", "a b c d e", "a b c d e f a b c d e f", "Éa é\x1cb　c d\xa0e f g h i"):
        assert len(next(jaccard.shingle_sets([t.encode()]))) == len(plain_set(t))


def test_rows_that_share_an_id_and_a_set_are_one(spark):
    rows = [(None, "A b c d e f"), (None, "a b c d e f"), (None, "a  b c d e f"), (5, "x y z u v w"), (5, "X y z u v w"), (5, "other words stand here now"), (6, ""), (6, ""), (7, "k l m n o p q"), (8, "k l m n o p q")]
    got = [(r.doc_id, (r.text or "").lower().split()) for r in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    assert sorted(got, key=str) == sorted([(None, "a b c d e f".split()), (5, "x y z u v w".split()), (5, "other words stand here now".split()), (6, []), (6, []), (7, "k l m n o p q".split())], key=str)


def test_joins_of_frequent_keys(spark):
    left = spark.createDataFrame([(1 if i < 900 else i, i) for i in range(1200)] + [(None, 7)], "k long, v long")
    right = spark.createDataFrame([(i, i * 10) for i in [1, *range(900, 1100)]], "k long, w long")
    for how in ("inner", "left"):
        want = Counter(tuple(r) for r in left.join(right, "k", how).collect())
        assert Counter(tuple(r) for r in jaccard.joined_by(left, right, "k", 8, how).select("k", "v", "w").collect()) == want
