"""Queries against their DuckDB statements on prices that cross zero: ratios are negative, logarithms NaN."""

import math
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
PICKED = [
    "validation_metrics",
    "technical_features",
    "model_input_columns",
    "condition_flags",
    "confirmed_labels",
    "confirmed_with_required_flags",
    "filled_features",
    "market_structure",
    "filled_table",
    "labeled_table",
    "model_features",
    "scaler_statistics",
    "standardized_features",
]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def duck(tmp_path_factory):
    """The events with values a hundred times as large, which move the price path far below zero."""
    folder = tmp_path_factory.mktemp("crossing")
    con = duckdb.connect()
    con.execute(
        f"copy (select * replace (value * 100 as value) from '{FOLDER}/events.parquet') to '{folder}/events.parquet' (format parquet)"
    )
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    return con, str(folder)


def alike(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        # per cents of a mean taken as 1e-9 show the last bits of the mean
        return math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-12, abs_tol=1.0 if abs(b) > 1e8 else 1e-9)
    return a == b


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql_below_zero(spark, duck, name):
    con, folder = duck
    cur = con.execute(oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    by = lambda row: (row["symbol"], str(row.get("ts")))
    want = sorted((dict(zip(columns, r, strict=True)) for r in cur.fetchall()), key=by)
    got = sorted((r.asDict() for r in queries()[name](spark, folder).collect()), key=by)
    assert len(got) == len(want) > 0
    assert sorted(columns) == sorted(got[0])
    assert [(c, a[c], b[c]) for a, b in zip(got, want, strict=True) for c in columns if not alike(a[c], b[c])] == []
