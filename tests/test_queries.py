"""Every registered query against its DuckDB SQL on the smallest tables
(the driver's gate runs the same comparison at sf0.01)."""
import math
from collections import Counter

import duckdb
import pytest

from spanflow.plans.registry import load_all_plans
from spanflow.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
Q, O = load_all_plans()


def _norm(v):
    if isinstance(v, float):
        return round(v, 6) if not math.isnan(v) else "nan"
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(n for n in O))
def test_query_matches_oracle(spark, con, name):
    df = Q[name](spark, SF)
    rows = df.collect()
    rel = con.sql(O[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    oorder = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    got = Counter(tuple(_norm(r[i]) for i in order) for r in rows)
    exp = Counter(tuple(_norm(r[i]) for i in oorder) for r in rel.fetchall())
    assert got == exp


@pytest.mark.parametrize("name", sorted(n for n in Q if n not in O))
def test_rows_only_queries_run(spark, name):
    assert Q[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0 and "true_features" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())
