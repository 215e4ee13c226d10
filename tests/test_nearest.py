"""Nearest vectors of many queries against all pairs."""

import math

import numpy as np
import pytest

from siftmark.operators import nearest, search


def plain(rows, queries, top, least):
    out = set()
    unit = lambda x: (lambda n: None if n == 0 else np.array(x) / n)(math.sqrt(sum(float(c) * c for c in x)))
    held = [(i, unit(x)) for i, x in rows if i is not None and x and None not in x and unit(x) is not None]
    for q, x in queries:
        if q is None or not x or None in x or unit(x) is None:
            continue
        scored = [(float((unit(x) * v).sum()), i) for i, v in held if len(v) == len(x)]
        scored = sorted(((s, i) for s, i in scored if math.isnan(s) or s >= least), key=lambda p: (not math.isnan(p[0]), -p[0] if not math.isnan(p[0]) else 0, p[1]))
        out |= {(q, i) for _, i in scored[:top]}
    return out


def cases():
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 8))
    clustered = [(i, (middle[i % 12] + 0.05 * rng.normal(size=8)).tolist()) for i in range(1500)]
    copies = [(i, [1.0, 2.0, 3.0] if i % 3 else [float(i), 1.0, 0.5]) for i in range(300)]
    odd = [(0, [1.0, 0.0]), (1, [1.0, 0.0005]), (2, [1.0, 0.0001]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.0]), (10, [float("inf"), 1.0])]
    spread = [(i, rng.normal(size=5).tolist()) for i in range(400)]
    return {"clustered": clustered, "copies": copies, "odd": odd, "spread": spread}


@pytest.mark.parametrize("name", ["clustered", "copies", "odd", "spread"])
@pytest.mark.parametrize(("top", "least"), [(5, 0.0), (3, 0.99), (2, -1.0)])
def test_search_against_all_pairs(spark, name, top, least):
    rows = cases()[name]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = [r for r in rows if name == "odd" or (r[0] or 0) % 20 == 0]
    got, told = nearest.search(df, spark.createDataFrame(asked, "vec_id long, embedding array<double>"), top, least)
    assert {(r.query_id, r.vec_id) for r in got.collect()} == plain(rows, asked, top, least)
    r = told.first()
    assert 0 < r.asked <= r.all_pairs and (name != "clustered" or least < 0.99 or r.asked < 0.5 * r.all_pairs)


def test_search_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    some = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert search.semantic_search_all(df, some).isEmpty() and search.semantic_search_all(some, df).isEmpty()
    assert [tuple(r) for r in search.semantic_search_all(some, some).collect()] == [(1, 1, pytest.approx(1))]


def test_near_ties_as_one_query_has_them(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0005]), (3, [1.0, 0.0001])], "vec_id long, embedding array<double>")
    got = [r.vec_id for r in search.semantic_search_all(df, df.where("vec_id = 3"), 2).orderBy("score", ascending=False).collect()]
    assert got == [r.vec_id for r in search.semantic_search(df, [1.0, 0.0001], 2).collect()] == [3, 1]


def test_what_moves_grows_with_vectors_and_queries_not_with_their_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(3000)]  # bounds skip little
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (lambda x: [x.apply(i) for i in range(x.size())])(store.stageList(gateway.jvm.java.util.ArrayList(), False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList()))}
    before = stages()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large to send
    try:
        got = search.semantic_search_all(df, df.where("vec_id % 20 = 0")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r.query_id, r.vec_id) for r in got} == plain(rows, rows[::20], 5, 0.0)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    moved = sum(n for k, n in stages().items() if k not in before)
    assert 0 < moved < 10 * (len(rows) + len(got))


def test_of_equal_vectors_the_first_answer(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(2000)] + [(i, [3.0, float(i), 1.0]) for i in range(2000, 2100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got, told = nearest.search(df, df.where("vec_id % 20 = 0"), 5)
    assert {(r.query_id, r.vec_id) for r in got.collect()} == plain(rows, [r for r in rows if r[0] % 20 == 0], 5, 0.0)
    r = told.first()
    assert 0 < r.asked < 0.1 * r.all_pairs == 0.1 * 105 * 2100


def test_contenders_keep_ties_and_the_first_nans():
    nan, none = float("nan"), np.full(1, -np.inf)
    pick = lambda row, bar, top: nearest.contenders(np.array([row]), bar, top)[1].tolist()
    assert pick([0.1, 0.5, 0.5, 0.5, 0.2, 0.1, 0.0], none, 2) == [1, 2, 3]
    assert pick([0.1, nan, 0.9, nan, nan], none, 2) == pick([0.1, nan, 0.9, nan, nan], np.full(1, np.inf), 2) == [1, 3]
    assert pick([0.1, 0.5, 0.4], np.full(1, 0.4), 2) == [1, 2] and pick([0.1], np.full(1, 0.4), 2) == []


def test_ask_in_small_blocks_against_all_pairs(monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 7)
    monkeypatch.setattr(nearest, "PAIRS", 16)
    rng = np.random.default_rng(6)
    v, _ = nearest.units(np.round(rng.normal(size=(300, 4)), 1))
    ids = np.arange(1000, 1000 + len(v))
    middle = nearest.centres(v, 9)
    cluster = (v @ middle.T).argmax(1)
    order = np.lexsort((ids, cluster))
    held = nearest.blocks(cluster[order], ids[order], v[order], middle)
    assert sum(len(b[0]) for b in held) == len(v) and all(len(b[0]) <= 7 for b in held)
    for top, least in ((1, -1.0), (5, 0.0), (4, 0.999)):
        i, own, score, asked = nearest.ask(v[:40], held, top, least)
        want = []
        for k in range(40):
            s = nearest.dots(v[k : k + 1], v)
            want += [(k, int(ids[j]), s[j]) for j in np.lexsort((ids, -s))[:top] if s[j] >= least]
        assert list(zip(i.tolist(), own.tolist(), score.tolist(), strict=True)) == want and 0 < asked <= 40 * len(v)
