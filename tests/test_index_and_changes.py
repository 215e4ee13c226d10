"""The trigram index, changes of many rules, and a store's rules as a stream."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftmark.operators import grams, library, search
from siftmark.operators.store import Store
from siftmark.streaming.changes import rule_changes


@pytest.mark.parametrize("part", ["lic", "LICENSE", "é", "ab", "a b", "zzz", "名称", "客户名", "%_", "\U0001f600bc", ""])
def test_index_finds_what_a_scan_finds(spark, tmp_path, part):
    rows = [(1, "a.txt", "The License"), (2, "LIC.doc", None), (3, None, "客户名称 é"), (4, "x", "a bab"), (5, "", "li c%_"), (6, "\U0001f600bc", "the\nlicence"), (7, "lice", "nse")]
    df = spark.createDataFrame(rows, "id long, file_name string, text string")
    grams.write(grams.indexed(df, "id", buckets=8), f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    got = {r.id for r in grams.holding(df, index, part, "id", buckets=8).collect()}
    assert got == {i for i, *texts in rows if any(t is not None and part.lower() in t.lower() for t in texts)}


def test_lookups_with_an_index(spark):
    rows = [(i, f"file-{i}.TXT", f"text {i} License" if i % 3 else "other", "kind", "low", i // 4, "h") for i in range(60)]
    df = spark.createDataFrame(rows, "sensitive_file_id long, file_name string, text string, sensitive_type string, risk_level string, uploaded_at long, sha256 string")
    index = grams.indexed(df, "sensitive_file_id")
    for text in ("license", "-1", "le-2", "no such"):
        assert search.find_samples(df, text, index=index).collect() == search.find_samples(df, text).collect()
        assert search.query_file(df, "sensitive_file_id", file_name=text, index=index).collect() == search.query_file(df, "sensitive_file_id", file_name=text).collect()


def test_changes_of_many_rules(spark):
    rules = spark.createDataFrame([(f"r{i}", "keyword", "t", "low", "sample", i, i % 2 == 0, i % 3 == 0) for i in range(8)], library.RULE)
    changes = spark.createDataFrame([("r1", 20, True, None, "high"), ("r1", 19, False, True, "info"), ("r2", 21, None, True, None), ("r3", 22, True, None, None), ("r4", 23, True, True, None), ("gone", 24, True, None, None)], "rule_id string, version int, enabled boolean, deleted boolean, risk_level string")
    got = {r.rule_id: (r.version, r.enabled, r.deleted, r.risk_level) for r in library.change(rules, changes).collect()}
    assert got == {"r0": (0, True, True, "low"), "r1": (20, True, False, "high"), "r2": (21, False, True, "low"), "r3": (22, True, False, "low"), "r4": (23, False, True, "low"), "r5": (5, False, False, "low"), "r6": (6, True, True, "low"), "r7": (7, False, False, "low")}
    one = library.change(rules, spark.createDataFrame([("r5", 9, True)], "rule_id string, version int, enabled boolean"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, library.update(rules, "r5", 9, enabled=True).collect()))


def test_rules_as_a_stream_over_restarts(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    seen = []

    def run():
        q = rule_changes(spark, f"{tmp_path}/store").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        rows = Counter((r.rule_id, r.version, r.state) for r in spark.read.parquet(f"{tmp_path}/out").collect())
        new, seen[:] = rows - Counter(seen), list(rows.elements())
        return new

    def put(version, **fields):
        snap = store.manifest()
        rules = store.table("rules", snap)
        new = spark.createDataFrame([(k, "keyword", "t", "low", "sample", version, v, not v, 0, "{}") for k, v in fields.items()], rules.schema)
        store.commit(snap, {"rules": rules.join(new, "rule_id", "left_anti").unionByName(new)}, "test", library_version=version)

    first = run()
    assert len(first) == store.table("rules").count() and all(v == 0 for _, v, _ in first)
    put(1, a=True, b=True)
    put(2, b=False)
    assert run() == {("a", 1, "live"): 1, ("b", 2, "deleted"): 1}
    assert run() == {}
    put(3, a=False, c=True)
    assert run() == {("a", 3, "deleted"): 1, ("c", 3, "live"): 1} and max(Counter(seen).values()) == 1
    assert spark.read.parquet(f"{tmp_path}/out").where(F.col("state") == "live").count() == len(first) + 2
