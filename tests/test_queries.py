"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from furrow.plans.registry import oracle_sql, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.mark.parametrize("name", [*queries()])
def test_query_equals_sql(spark, duck, name):
    got = queries()[name](spark, DATA).toPandas()
    if name not in oracle_sql():
        assert len(got)
        return
    want = duck.sql(oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    got, want = (df[cols].sort_values(cols).reset_index(drop=True) for df in (got, want))
    assert len(got) == len(want)
    for c in cols:
        other = (got[c] != want[c]) & ~(got[c].isna() & want[c].isna())
        assert not other.any(), (c, got[c][other].iloc[0], want[c][other].iloc[0])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert {*queries()} <= {*entry.queries()} and {*entry.oracle_sql()} <= {*entry.queries()}
