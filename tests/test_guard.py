"""Guarded SQL: what it refuses, and what it shows."""

import time

import pytest

from siftmark.operators.guard import Forbidden, TooSlow, answered, guarded


@pytest.fixture
def tables(spark):
    return {"events": spark.createDataFrame([(1, "alice", "x"), (2, "bo", "y"), (3, "c", "x"), (4, None, "x")], "id int, user string, dept string"), "Odd name": spark.range(3).withColumnRenamed("id", "a`b")}


@pytest.fixture
def secret(spark):
    spark.createDataFrame([(7, "s")], "id int, v string").createOrReplaceTempView("hidden")
    spark.createDataFrame([(8,)], "id int").createOrReplaceTempView("events")
    yield
    spark.catalog.dropTempView("hidden")
    spark.catalog.dropTempView("events")


REFUSED = [
    "DROP TABLE events", "INSERT INTO events SELECT 1", "SELECT * FROM other", "SELECT * FROM parquet.`/etc`", "SELECT * FROM events WHERE id IN (SELECT id FROM secret)", "SELECT reflect('java.lang.System', 'exit', 1)", "DELETE FROM events",
    "SELECT * FROM range(10)", "SET x=1", "SELECT id, v FROM hidden WHERE v != ', hidden as ('", "SELECT * FROM (WITH hidden AS (SELECT 1) SELECT * FROM hidden) x, hidden", "WITH a AS (SELECT * FROM hidden), hidden AS (SELECT 1) SELECT * FROM a",
    "SELECT 1 /* , hidden AS ( */ FROM hidden", "SELECT (SELECT max(id) FROM hidden)", "SELECT * FROM events e WHERE EXISTS (SELECT 1 FROM hidden h WHERE h.id = e.id)", "SELECT * FROM events ORDER BY (SELECT max(id) FROM hidden)",
    "SELECT * FROM spark_catalog.default.events", "SELECT * FROM IDENTIFIER('hidden')", "SELECT `reflect`('a', 'b')", "SELECT system.builtin.reflect('a', 'b')", "SELECT input_file_name() FROM events", "SELECT my_udf(id) FROM events", "FROM hidden SELECT *", "TABLE hidden", "VALUES (1), ((SELECT max(id) FROM hidden))",
    "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r) SELECT * FROM r", "SELECT * FROM events LATERAL VIEW explode((SELECT collect_list(id) FROM hidden)) t AS z", "SELECT sum(id) OVER (ORDER BY (SELECT max(id) FROM hidden)) FROM events", "SELECT * FROM events; DROP VIEW hidden", "SELECT 1) x, (SELECT * FROM hidden",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, tables, secret, sql):
    spark.udf.register("my_udf", lambda x: x)
    with pytest.raises(Exception) as e:
        guarded(spark, sql, tables)
    assert isinstance(e.value, Forbidden) or "Parse" in type(e.value).__name__


def test_allowed(spark, tables, secret):
    run = lambda sql, **k: [tuple(r) for r in guarded(spark, sql, tables, **k).collect()]
    assert run("SELECT user FROM events ORDER BY id", limit=3, masked=("USER",)) == [("a***e",), ("***",), ("***",)]
    assert run("SELECT user FROM events WHERE id = 4", masked=("user",)) == [(None,)]
    assert run("WITH e AS (SELECT * FROM events) SELECT count(*) FROM e WHERE id IN (SELECT id FROM events)", where={"events": "dept = 'x'"}) == [(3,)]
    assert run("WITH events AS (SELECT 5 AS id) SELECT id FROM events") == [(5,)]
    assert run("SELECT * FROM events ORDER BY id DESC LIMIT 1", columns={"events": ("id",)}) == [(4,)]
    with pytest.raises(Exception, match="dept"):
        run("SELECT id FROM events WHERE dept = 'x'", columns={"events": ("id",)})
    assert run("SELECT sum(`a``b`) FROM `odd NAME`") == [(3,)]
    assert run("SELECT 1 -- no table", limit=1) == [(1,)] and run("SELECT id FROM events ORDER BY id -- behind\n;", limit=1) == [(1,)]
    assert run("SELECT a.id FROM events a JOIN LATERAL (SELECT max(id) AS m FROM events b WHERE b.dept = a.dept) x ON a.id = x.m ORDER BY 1") == [(2,), (4,)]
    assert [r.id for r in spark.table("events").collect()] == [8]  # the session's own view is as it was
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("guarded_")]


def test_time_limit(spark):
    many = {"events": spark.range(3_000_000).repartition(8).withColumnRenamed("id", "n")}
    began = time.time()
    with pytest.raises(TooSlow):
        answered(spark, "SELECT count(*) FROM events a, events b WHERE a.n * b.n % 7 = 3", many, seconds=2)
    assert time.time() - began < 60
    assert answered(spark, "SELECT max(n) AS m FROM events", many, seconds=60)[0].m == 2_999_999
    with pytest.raises(Exception, match="nothing"):
        answered(spark, "SELECT nothing FROM events", many)
