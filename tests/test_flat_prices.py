"""Queries against their DuckDB statements on flat closes: only the last bits of the means tell one from another."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from __spark_entry__ import oracle_sql, queries
from barloom.plans.blocks import Ewm, in_blocks
from barloom.queries import tidy
from conftest import SCHEMA, collected, walk

FOLDER = "/root/testdata/sf0.001"
PICKED = ["confirmed_labels", "confirmed_with_required_flags", "labeled_table"]


def recursion(x, alpha):
    out, y = [], None
    for v in x:
        y = v if y is None else (1.0 - alpha) * y + alpha * v
        out.append(y)
    return np.array(out)


@pytest.mark.parametrize("rows", [64, 1 << 15])
def test_recursive_means_have_the_bits_of_the_recursion_in_any_layout(spark, rows):
    wave, flat = walk("a", 9000, 1), walk("b", 5000, 2)
    flat[["open", "high", "low", "close"]] = 1000.1
    series = {"a": wave, "b": flat}
    alphas = {"fast": 2 / 6, "wilder": 1 / 14, "slow": 2 / 51}
    bars = spark.createDataFrame(wave, SCHEMA).union(spark.createDataFrame(flat, SCHEMA))
    b = in_blocks(bars, back=1700, rows=rows).recursive({name: Ewm("close", a, 3) for name, a in alphas.items()})
    got = collected(b.core())
    for symbol, frame in series.items():
        mine = got[got["symbol"] == symbol]
        assert len(mine) == len(frame)
        for name, a in alphas.items():
            assert mine[name].isna().sum() == 2
            assert (mine[name].to_numpy()[2:] == recursion(frame["close"], a)[2:]).all(), (symbol, name)


@pytest.fixture(scope="module")
def duck(tmp_path_factory):
    """The events six times under keys shifted by an odd number: the steps of a moment cancel, closes stay at 1,000."""
    folder = tmp_path_factory.mktemp("flat")
    con = duckdb.connect()
    con.execute(
        f"copy (select * replace (event_id + k * 100001 as event_id) from '{FOLDER}/events.parquet', range(6) t(k)) "
        f"to '{folder}/events.parquet' (format parquet)"
    )
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    return con, str(folder)


def alike(a, b) -> bool:
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")
@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql_on_flat_closes(spark, duck, name):
    con, folder = duck
    cur = con.execute(oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    by = lambda row: (row["symbol"], str(row["ts"]))
    want = sorted((dict(zip(columns, r, strict=True)) for r in cur.fetchall()), key=by)
    got = sorted((r.asDict() for r in queries()[name](spark, folder).collect()), key=by)
    assert len(got) == len(want) > 0
    assert sorted(columns) == sorted(got[0])
    assert [(c, a[c], b[c]) for a, b in zip(got, want, strict=True) for c in columns if not alike(a[c], b[c])] == []


def test_large_values_are_rounded_as_in_the_sql(spark):
    rng = np.random.default_rng(5)
    values = [float(s * 10.0**e) for s, e in zip(rng.uniform(-10, 10, 3000), rng.integers(7, 16, 3000))]
    values += [math.inf, -math.inf, 1e300, 0.1234565]
    rows = [(i, v) for i, v in enumerate(values)]
    got = {r["i"]: r["x"] for r in tidy(spark.createDataFrame(rows, "i bigint, x double")).collect()}
    want = duckdb.connect().execute("select i, round(x, 6) + 0.0 from (select unnest(range(?)) i, unnest(?::double[]) x)", [len(rows), values])
    assert [(values[i], got[i], x) for i, x in want.fetchall() if got[i] != x] == []
