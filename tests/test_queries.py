"""Registered queries against their DuckDB statements on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import rows_of

FOLDER = "/root/testdata/sf0.001"
PICKED = [
    "hourly_event_bars",
    "candle_payload_bars",
    "backfill_manifest",
    "split_summary",
    "model_features",
    "market_structure",
    "higher_timeframe_context",
    "best_trade_labels",
    "magnitude_buckets",
    "trade_ledger",
    "equity_curve",
]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    cur = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())


def test_entry_runs(spark):
    assert entry(spark).count() == 15


def test_every_statement_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())
