"""The entry module: a flagship query, queries with their SQL, and equality with DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tickloom.plans import catalog

SMALL = ["candles_daily_orders", "candle_gaps", "signal_runs", "trades_base_both", "metrics_full", "walk_forward_plan", "equity_curve", "phase_scores", "adaptive_metrics"]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(catalog.QUERIES) > 40


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SMALL)
def test_equal_to_sql(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in ("orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda row: [(x is None, str(round(x, 6)) if isinstance(x, float) else str(x)) for x in row]
    mine, theirs = sorted((tuple(r[c] for c in names) for r in df.collect()), key=key), sorted(found.fetchall(), key=key)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-6)) for x, y in zip(a, b)), (a, b)
