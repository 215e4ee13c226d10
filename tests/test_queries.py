"""Every query with SQL against DuckDB on the same tables, and the others for rows."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from siftmark.plans.queries import ORACLES, QUERIES

TABLES = "documents embeddings pages benchmark conversations events labels".split()


def plain(v):
    return round(v, 5) if isinstance(v, float) and not math.isnan(v) else v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir)
    if name not in ORACLES:
        assert got.count() > 0
        return
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = db.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    a = Counter(tuple(plain(r[n]) for n in names) for r in got.collect())
    b = Counter(tuple(plain(v) for v in r) for r in want.fetchall())
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "rule_name", "risk_level", "match_count", "origin"]
