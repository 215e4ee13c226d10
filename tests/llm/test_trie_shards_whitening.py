"""The conversation trie, sharding and whitening against brute force and SQL."""

import hashlib
import math
import re
import zlib
from array import array
from collections import Counter, defaultdict
from itertools import accumulate

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftmark.llm import conversations, registry, sharding, whitening
from siftmark.llm.common import shared_dir

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_sql(folder, name, columns):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if 'testdata' not in folder else ''}')")
    return Counter(con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall())


def all_rows(df, columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def plain_trie(sequences):
    """sequences: conversation -> list of (role, text)."""
    members = defaultdict(set)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, ms in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(ms) - 1) * len(WORDS.findall(k[-1][1])) if k else 0
    out = Counter()
    for k, ms in members.items():
        ends = ",".join(map(str, sorted(c for c in ms if len(sequences[c]) == len(k))))
        out[(min(ms), len(k), min(members[k[:-1]]) if k else None, len(ms), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def rebuilt(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{x or ''}".encode()).hexdigest(), x or ""))
    own = {c: [(r, x) for *_, r, _, x in sorted(v)] for c, v in turns.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
    return out


def test_trie(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = all_rows(conversations.op11_conversation_trie(spark, tables), NODE)
    assert got == plain_trie(rebuilt(rows))
    assert got == by_sql(tables, "op11_conversation_trie", NODE)


@pytest.mark.parametrize("n", [1, 3, 40])
def test_trie_of_copies_and_common_beginnings_over_many_tasks(spark, n, monkeypatch):
    monkeypatch.setattr(conversations, "HELD", 7)
    said = {c: [("u", "hello all of you")] * (c % 3) + [("a", f"{c % 5} b")] * (c % 4) + ([("u", str(c))] if c % 7 == 0 else []) for c in range(400)}
    said |= {c: [("s", "long one")] * 90 for c in range(400, 520)}
    rows = [(c, k, r, x) for c, v in said.items() for k, (r, x) in enumerate(v)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        got = all_rows(conversations.trie(conversations.sequences(df), shared_dir(spark, "trie")), NODE)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert got == plain_trie({c: v for c, v in said.items() if v})


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a" * 16, b"b" * 16, b"a" * 15 + b"c"]), max_size=9), max_size=40), st.sampled_from([1, 700, 10**9]))
def test_merged_runs(keys, size):
    runs = conversations.Runs(size)
    for i, k in enumerate(keys):
        runs.add((b"".join(k), i, array("q", [1] * len(k))))
    got, want, last = list(runs.merged()), sorted((b"".join(k), i) for i, k in enumerate(keys)), []
    assert [s[:2] for s, _ in got] == want
    for s, lcp in got:
        now = [s[0][i : i + 16] for i in range(0, len(s[0]), 16)]
        assert lcp == next((i for i, (x, y) in enumerate(zip(now, last)) if x != y), min(len(now), len(last)))
        last = now


def test_merging_compares_no_shared_turn_twice(monkeypatch):
    """Copies of a long conversation: turns are compared once per run, not once per match."""
    seen, plain = [], conversations.shared
    monkeypatch.setattr(conversations, "shared", lambda a, b, at=0: seen.append(plain(a, b, at) - at) or at + seen[-1])
    runs = [iter([((b"x" * 16 * 500 + bytes([i, k]) * 8, 0, None), 500 if k else 0) for k in range(20)]) for i in range(8)]
    assert len(list(conversations.merge(runs))) == 160
    assert sum(seen) <= 500 * 8 + 200


SHARD = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def plain_capacity(sizes, shards):
    edge, low, high = [0, *accumulate(sizes)], 0, sum(sizes)
    while low < high:
        mid, at = (low + high) // 2, 0
        for _ in range(shards):
            at = max(p for p in edge if p <= at + mid)
        low, high = (low, mid) if at == edge[-1] else (mid + 1, high)
    return low


def test_sharding(spark, tables, docs):
    got = sharding.op12_sharding(spark, tables)
    assert all_rows(got, SHARD) == by_sql(tables, "op12_sharding", SHARD)
    rows = got.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs)
    slots, bytes_, least = defaultdict(list), Counter(), {}
    for r in rows:
        slots[r.shard].append(r.slot)
        bytes_[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(8))
    for i, t in docs:
        least[t] = min(least.get(t, (True, 0)), (i is None, i or 0))
    order = sorted(least, key=lambda t: (not least[t][0], least[t][1], hashlib.sha256(t.encode()).digest()))
    n = Counter(t for _, t in docs)
    assert max(bytes_.values()) == plain_capacity([n[t] * (len(t.encode()) + 1) for t in order], 8)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 10_000)), max_size=60), st.integers(1, 9), st.integers(1, 9), st.integers(2, 5))
def test_cuts(sizes, shards, home, parts):
    stored = [sizes[i : i + home] for i in range(0, len(sizes), home)]

    def refine(blocks):
        out = []
        for b in blocks:
            assert b.groups > 1
            by = defaultdict(list)
            for k in range(b.groups):
                by[k * parts // b.groups].append(k)
            out.append([sharding.Block(b.home, b.first + v[0], len(v), sum(stored[b.home][b.first - 1 + k] for k in v)) for v in by.values()])
        return out

    capacity, cuts, _ = sharding.cut([sharding.Block(i, 1, len(x), sum(x)) for i, x in enumerate(stored)], shards, refine)
    edge = [0, *cuts, sum(sizes)]
    assert capacity == plain_capacity(sizes, shards)
    assert set(cuts) <= {0, *accumulate(sizes)} and all(0 <= b - a <= capacity for a, b in zip(edge[:-1], edge[1:]))


def test_shards_of_any_columns(spark):
    """Null groups and sizes, a group of a third of all rows, clashing and odd names, few groups."""
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 500 END AS `g e`", "CASE WHEN id % 11 = 0 THEN NULL ELSE id % 7 - 1 END AS size", "1 AS shard", "'x' AS `row`", "id AS _0")
    out = sharding.sharded(df, 5, "g e", "size")
    assert out.columns == ["doc_id", "g e", "size", "row", "_0", "shard", "slot"]
    rows = out.collect()
    where = defaultdict(set)
    for r in rows:
        where[r["g e"]].add(r.shard)
    assert len(rows) == 3000 and all(len(v) == 1 for v in where.values())
    two = sharding.sharded(spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, "b", 1)], "doc_id long, group string, size long"), 4).collect()
    assert sorted((r.group, r.slot) for r in two) == [("a", 0), ("a", 1), ("b", 0)] and len({r.shard for r in two}) == 2


def test_one_large_group_leaves_no_shard_empty(spark):
    df = spark.range(800).selectExpr("id AS doc_id", "CASE WHEN id < 300 THEN 0 ELSE id END AS group", "1 AS size")
    by = {r.shard: r["count"] for r in sharding.sharded(df, 6).groupBy("shard").count().collect()}
    assert by == {0: 300, 1: 100, 2: 100, 3: 100, 4: 100, 5: 100}


def plain_whitening(rows):
    kept = [(i, [math.floor(64 * c) + 10**6 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = (fit * n - s) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    return [i for i, _ in kept], n, ((n * x - s) ** 2).sum(1).tolist(), ((n * x - s) / n) @ u / np.sqrt(e), e / np.trace(centred.T @ centred / n)


def test_whitening(spark, tables):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    ids, n, deviation, white, explained = plain_whitening(rows)
    got = whitening.op13_whitening(spark, tables).collect()
    k = white.shape[1]
    assert len(got) == k * len(ids) and {r.n for r in got} == {n}
    assert Counter((r.vec_id, r.deviation) for r in got) == Counter({x: m * k for x, m in Counter(zip(ids, deviation)).items()})
    assert all(abs(r.explained / explained[r.component - 1] - 1) < 1e-9 for r in got) and {r.identity_error for r in got}.pop() < 1e-9
    by = defaultdict(list)
    for r in got:
        by[r.vec_id, r.component].append(r.whitened)
    for c in range(k):
        mine = np.array([by[i, c + 1][0] for i in ids])
        sign = 1 if mine @ white[:, c] > 0 else -1
        assert np.abs(mine - sign * white[:, c]).max() < 1e-8


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 6), st.integers(1, 9), st.integers(0, 10**9), st.randoms(use_true_random=False))
def test_merged_factors_lose_nothing(n, d, parts, offset, r):
    x = np.array([[r.randint(0, 50) + offset for _ in range(d)] for _ in range(n)], np.int64)
    factors = [whitening.Factor.of(x[i::parts]) for i in range(parts) if len(x[i::parts])]
    whole = factors[0]
    for f in factors[1:]:
        whole = whole.merge(whitening.Factor.from_row(*list(f.row(0).values())[1:]))
    centred = (n * x - x.sum(0)) / n
    assert whole.n == n and whole.sums == x.sum(0).tolist()
    assert np.abs(whole.covariance() - centred.T @ centred / n).max() < 1e-9


def test_whitening_without_variance_and_with_other_lengths(spark, tmp_path):
    def of(rows):
        folder = f"{tmp_path}/{len(list(tmp_path.iterdir()))}"
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
        return whitening.op13_whitening(spark, folder).collect()

    assert of([(1, [1.0, 2.0])]) == of([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    flat = of([(1, [1.0, 2.0]), (2, [1.0, 4.0]), (3, [1.0, 9.0])])
    assert sorted((r.vec_id, r.component) for r in flat) == [(1, 1), (2, 1), (3, 1)] and all(abs(r.explained - 1) < 1e-12 for r in flat)
    with pytest.raises(Exception, match="dimensions"):
        of([(1, [1.0, 2.0]), (2, [1.0, 4.0, 1.0])])


def test_many_factors_meet_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 3)
    df = spark.range(500).select(F.array(F.col("id") % 7, F.col("id") % 11, F.col("id")).alias("x")).repartition(30)
    whole = whitening.factored(df, shared_dir(spark, "factors"))
    x = np.array([[i % 7, i % 11, i] for i in range(500)])
    assert whole.n == 500 and np.allclose(whole.covariance(), np.cov(x.T, bias=True), rtol=1e-10)


def test_vectors_of_fractions(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)) * [9, 5, 3, 1, 0.5] + 4
    df = spark.createDataFrame([(i, v.tolist(), "kept") for i, v in enumerate(x)], "id long, `my vec` array<double>, whitened string")
    model, error = whitening.whitening(df.select("my vec"), shared_dir(spark, "fractions"), 5)
    out = whitening.transform(df, model, "my vec").orderBy("id").collect()
    w = np.array([r.whitened for r in out])
    assert error < 1e-9 and np.abs(np.cov(w.T, bias=True) - np.eye(5)).max() < 1e-9 and out[0].deviation is None
