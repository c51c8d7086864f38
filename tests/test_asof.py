"""As-of joins against pandas and against a row-by-row search."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators.asof import asof_join

LEFT, RIGHT = "k string, ts timestamp_ntz, a long", "k string, ts timestamp_ntz, seq long, x double"


def random_frames(seed, n, m, span):
    rng = np.random.default_rng(seed)
    start = pd.Timestamp("2024-01-01")
    key = lambda size: rng.choice(["hot", "hot", "hot", "b", "c"], size)
    left = pd.DataFrame({"k": key(n), "ts": start + pd.to_timedelta(rng.integers(0, span, n), unit="s"), "a": np.arange(n)})
    right = pd.DataFrame({"k": key(m), "ts": start + pd.to_timedelta(rng.integers(0, span, m), unit="s"), "seq": np.arange(m), "x": rng.normal(size=m)})
    right.loc[::10, "x"] = np.nan
    return left, right


def searched(left, right, strict=False, tolerance=None):
    out = {}
    by = {k: g.sort_values(["ts", "seq"]) for k, g in right.groupby("k")}
    for row in left.itertuples():
        rows = by.get(row.k)
        if rows is None:
            out[row.a] = None
            continue
        rows = rows[rows["ts"] < row.ts] if strict else rows[rows["ts"] <= row.ts]
        if tolerance is not None:
            rows = rows[rows["ts"] >= row.ts - pd.Timedelta(seconds=tolerance)]
        out[row.a] = int(rows["seq"].iloc[-1]) if len(rows) else None
    return out


@pytest.mark.parametrize("options", [{}, {"strict": True}, {"tolerance": 300}, {"strict": True, "tolerance": 0.5}])
@pytest.mark.parametrize("tile", [60, 86400 * 365])
def test_equals_a_search(spark, options, tile):
    left, right = random_frames(1, 900, 700, 20_000)
    l, r = spark.createDataFrame(left, LEFT).repartition(7), spark.createDataFrame(right, RIGHT).repartition(5)
    wanted = searched(left, right, **options)
    named = {"strict": options.get("strict", False), "tolerance_seconds": options.get("tolerance"), "tie": ["seq"], "tile_seconds": tile}
    got = asof_join(l, r, ["k"], **named)
    assert got.columns == ["k", "ts", "a", "right_ts", "right_seq", "right_x"]
    assert {x["a"]: x["right_seq"] for x in got.collect()} == wanted
    inner = asof_join(l, r, ["k"], how="inner", **named).collect()
    assert {x["a"]: x["right_seq"] for x in inner} == {a: s for a, s in wanted.items() if s is not None}


def test_equals_pandas(spark):
    left, right = random_frames(2, 500, 400, 10_000_000)
    right = right.drop_duplicates(["k", "ts"])
    want = pd.merge_asof(left.sort_values("ts"), right.sort_values("ts").rename(columns={"x": "right_x"}), on="ts", by="k").set_index("a")["right_x"]
    got = asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"]).toPandas().set_index("a")["right_x"]
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_dtype=False)


def test_nulls_empty_tables_and_names(spark):
    ts = dt.datetime(2024, 1, 2)
    left = spark.createDataFrame([("a", ts, 1), (None, ts, 2), ("a", None, 3), ("z", ts, 4), ("a", ts, 1)], LEFT)
    right = spark.createDataFrame([("a", ts, 1, None), (None, ts, 2, 1.0), ("a", None, 9, 2.0)], RIGHT)
    got = sorted(((r["a"], r["right_seq"], r["right_x"]) for r in asof_join(left, right, ["k"]).collect()), key=str)
    assert got == [(1, 1, None), (1, 1, None), (2, None, None), (3, None, None), (4, None, None)]
    assert asof_join(left, right.limit(0), ["k"]).where("right_seq is null").count() == 5
    assert asof_join(left, right, ["k"], how="inner").count() == 2
    assert asof_join(left.limit(0), right, ["k"]).count() == 0
    odd = left.withColumnsRenamed({"a": "_at"}).withColumn("_side", F.lit(7)).withColumn("_tile", F.lit(8))
    assert {(r["_at"], r["_side"], r["_tile"]) for r in asof_join(odd, right, ["k"]).collect()} == {(i, 7, 8) for i in (1, 2, 3, 4)}
    for wrong in ({"prefix": ""}, {"how": "outer"}):
        with pytest.raises(ValueError):
            asof_join(left, right, ["k"], **wrong)
    with pytest.raises(ValueError):
        asof_join(left, right.withColumn("ts", F.col("ts").cast("timestamp")), ["k"])


def test_a_hot_key_is_spread_over_tiles(spark):
    left, right = random_frames(3, 3000, 3000, 1_000_000)
    joined = asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], tile_seconds=10_000)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
