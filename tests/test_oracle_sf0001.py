"""Every query with oracle SQL, Spark vs DuckDB on sf0.001: same column
names, same row multiset (doubles compared at 6 places). Every registered
query is also checked for pair-producing joins in its physical plan."""

import duckdb
import pytest

import __spark_entry__ as entry
from marquee.sources.tables import TABLES
from tests.conftest import SF001
from tools.oracle_check import rows_of

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _no_pair_joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(f in plan for f in FORBIDDEN), plan[:2000]


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(ORACLE)))
def test_rows_only_query_runs_without_pair_joins(spark, name):
    df = entry.queries()[name](spark, SF001)
    _no_pair_joins(df)
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF001)
    _no_pair_joins(df)
    s_cols = df.columns
    s_rows = rows_of(s_cols, [tuple(r) for r in df.collect()])
    res = con.execute(ORACLE[name])
    d_cols = [d[0] for d in res.description]
    d_rows = rows_of(d_cols, res.fetchall())
    assert sorted(s_cols) == sorted(d_cols)
    assert s_rows == d_rows
