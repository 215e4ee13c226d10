"""White lists, reports and keyed alerts against plain Python."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftmark.streaming import events, keyed

AT = datetime(2024, 1, 31, 22)
SCHEMA = "event_id long, ts timestamp, user_id long, process_name string, file_path string, file_hash string, risk_level string, operation string"


def made(n, seed=1):
    r = random.Random(seed)
    paths = ["/a/f0.txt", "/a/f1.TXT", "/b/c/f2.doc", "C:\\x\\f3.doc", None, "/a", "rel/f"]
    return [(i, AT + timedelta(seconds=7 * i), r.choice([0, 1, 1, 1, None]), r.choice(["p", "q"]), r.choice(paths), r.choice(["h", "g", None]), r.choice(["low", "high", None, "odd"]), r.choice(["upload", "read"])) for i in range(n)]


def rows_of(df):
    return Counter((r.event_id, r.user_id, r.process_name, r.file_type, r.operation, r.window_start, r.is_merge_event, r.n_events, r.file_count, tuple((f["file_path"], f["file_hash"]) for f in r.files), r.first_ts, r.last_ts, r.risk_level) for r in df.collect())


@pytest.mark.parametrize("most", [None, 2])
def test_keyed_alerts_after_restarts_equal_the_batch(spark, tmp_path, most):
    rows = made(220)
    chunks = [rows[:90], rows[90:100], rows[100:], [(9999, AT + timedelta(days=1), 7, "p", "/z", "h", "low", "read")]]
    for i, c in enumerate(chunks):
        spark.createDataFrame(c, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = events.alerts(spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"), most_files=most)
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()  # a new query from the checkpoint each time
    whole = spark.createDataFrame(rows, SCHEMA)
    got = rows_of(spark.read.parquet(f"{tmp_path}/out"))
    assert got == rows_of(events.alerts(whole, most_files=most)) and sum(n * x[7] for x, n in got.items()) == len(rows)
    assert spark.conf.get(keyed.PROVIDER).endswith("RocksDBStateStoreProvider")


def test_alerts_list_all_files(spark):
    rows = [(i, AT + timedelta(milliseconds=i), 1, "p", f"/a/{i}.txt", "h", "low", "read") for i in range(250)]
    (a,) = events.alerts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert a.file_count == 250 and [f.file_path for f in a.files] == sorted(r[4] for r in rows) and a.n_events == 250


def test_white_lists_of_paths(spark):
    prefixes = ["/a/", "C:/x", None, "rel/f", "/b/c/f", "/"]
    rows = [*made(80), (1000, AT, 1, "p", "/", "h", "low", "read"), (1001, AT, 1, "p", "//a/x", "h", "low", "read")]
    df = spark.createDataFrame(rows, SCHEMA)
    for listed in (prefixes[:-1], prefixes, [None], []):
        given = spark.createDataFrame([(p,) for p in listed], "prefix string")
        norm = lambda p: (p.replace("\\", "/").rstrip("/") or "/") if p is not None else None
        inside = lambda p: p is not None and any(q is not None and (norm(p) == norm(q) or norm(p).startswith(norm(q).rstrip("/") + "/")) for q in listed)  # noqa: E731, B023
        got = events.allow_paths(df, given)
        assert got.columns == df.columns
        assert sorted(r.event_id for r in got.collect()) == sorted(r[0] for r in rows if not inside(r[4]))


def test_white_lists_of_times_and_hours(spark):
    rows = [(i, None if i % 17 == 0 else AT + timedelta(minutes=41 * i), i % 4 if i % 5 else None, "p", "/f", "h", "low", "read") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    spans = [(1, AT, AT + timedelta(days=3)), (None, AT + timedelta(hours=50), AT + timedelta(hours=51)), (2, None, AT), (3, AT, AT), (0, AT + timedelta(hours=90), AT + timedelta(hours=20)), (1, AT + timedelta(days=5), AT + timedelta(days=5, minutes=41))]
    given = spark.createDataFrame(spans, "user_id long, from_ts timestamp, to_ts timestamp")
    held = lambda t, u: t is not None and any(a and z and a <= t < z and (w is None or w == u) for w, a, z in spans)
    got = events.allow_times(df, given)
    assert got.columns == df.columns and "NestedLoop" not in got._jdf.queryExecution().toString()
    assert sorted(r.event_id for r in got.collect()) == [r[0] for r in rows if not held(r[1], r[2])]
    hours = [(None, 22, 2), (3, 9, 12), (2, 5, 5), (0, 23, 1)]
    at = lambda t, u: t is not None and any((a <= t.hour < z if a <= z else t.hour >= a or t.hour < z) and (w is None or w == u) for w, a, z in hours)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = events.allow_hours(df, spark.createDataFrame(hours, "user_id long, from_hour int, to_hour int"))
        assert "NestedLoop" not in got._jdf.queryExecution().toString()
        assert sorted(r.event_id for r in got.collect()) == [r[0] for r in rows if not at(r[1], r[2])]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ranking_shares_places(spark):
    df = spark.createDataFrame([(u,) for u, n in (("a", 3), ("b", 3), ("c", 5), ("d", 1), (None, 1)) for _ in range(n)], "user_id string")
    assert {(r.user_id, r.n_events, r.place) for r in events.ranking(df, "user_id").collect()} == {("c", 5, 1), ("a", 3, 2), ("b", 3, 2), ("d", 1, 4), (None, 1, 4)}


def test_sessions_as_a_stream(spark, sf_dir, tmp_path):
    src = spark.read.parquet(f"{sf_dir}/events.parquet")
    far = src.limit(1).withColumn("ts", F.lit("2090-01-01").cast("timestamp").cast(src.schema["ts"].dataType)).withColumn("user_id", F.lit(-1).cast("long"))
    src.unionByName(far).coalesce(2).write.parquet(f"{tmp_path}/in")  # the far event's watermark closes all sessions
    stream = events.risk_sessions(spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in"), "6 hours")
    q = stream.writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    plain = lambda df: Counter((r.user_id, str(r.first_ts), str(r.last_ts), r.n_events, r.highest) for r in df.collect())
    got = plain(spark.table("sessions"))
    assert got and got == plain(events.risk_sessions(src, "6 hours"))
