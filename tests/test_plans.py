import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import series as sr
from barloom.plans import scan
from barloom.plans.blocks import Ewm, decay_rate, fits_blocks, in_blocks, number_rows, number_short_series, segment_sizes
from barloom.plans.quantile import exact_quantile, exact_quantiles
from barloom.plans.scan import forward_fill, max_drawdown, running
from conftest import collected


def test_number_rows_counts_over_tiles(bars, bars_frame):
    plain = bars.drop("rn", "n")
    for numbered in (number_rows(plain, tile_seconds=50 * 3600), number_short_series(plain)):
        got = collected(numbered)
        assert (got["rn"] == bars_frame["rn"]).all()
        assert (got["n"] == bars_frame["n"]).all()


def test_segments_nest_and_cover_every_rate():
    alphas = [2 / 6, 2 / 201, 1 / 14, 2 / 1001]
    sizes = segment_sizes(alphas)
    assert all(a % b == 0 for a, b in zip(sizes, sizes[1:]))
    for a in alphas:
        assert any(39 <= decay_rate(a) * s <= 650 for s in sizes)


@pytest.mark.parametrize("rows", [64, 4500, 1 << 15])
def test_smoothing_equals_pandas_in_any_layout(bars, bars_frame, rows):
    outputs = {"fast": ("close", 2 / 6, 5), "slow": ("close", 2 / 201, 200), "wilder": ("volume", 1 / 14, 14)}
    got = collected(sr.smoothed(bars, outputs, rows=rows))
    for name, (source, alpha, need) in outputs.items():
        want = bars_frame.groupby("symbol")[source].transform(
            lambda x: x.ewm(alpha=alpha, adjust=False, min_periods=need).mean()
        )
        np.testing.assert_allclose(got[name], want, rtol=1e-13)


def test_smoothing_with_any_weight_equals_pandas(bars, bars_frame, monkeypatch):
    """Weights that forget nothing, fast ones, and segments and groups small enough to need every level."""
    weights = {"never": 1e-12, "slow": 1e-6, "mild": 2 / 6, "fast": 0.9, "last": 1.0 - 1e-9, "now": 1.0}
    requests = {name: Ewm("close", a, 3) for name, a in weights.items()}
    requests["late"] = Ewm("volume", 1e-5, 4, skip=2)
    wants = {name: bars_frame.groupby("symbol")["close"].transform(lambda x, a=a: x.ewm(alpha=a, adjust=False, min_periods=3).mean()) for name, a in weights.items()}
    skipped = bars_frame["volume"].where(bars_frame["rn"] >= 2)
    wants["late"] = skipped.groupby(bars_frame["symbol"]).transform(lambda x: x.ewm(alpha=1e-5, adjust=False, min_periods=4).mean())
    for group, rows in ((4096, scan.BLOCK_ROWS), (4, 8)):
        monkeypatch.setattr(scan, "GROUP", group)
        monkeypatch.setattr(scan, "BLOCK_ROWS", rows)
        got = collected(scan.smoothed(bars, requests))
        for name, want in wants.items():
            np.testing.assert_allclose(got[name], want, rtol=1e-12, err_msg=name)
    assert not fits_blocks(1e-12) and fits_blocks(2 / 6)
    np.testing.assert_allclose(collected(sr.smoothed(bars, {"y": ("close", 1e-6, 3)}))["y"], wants["slow"], rtol=1e-12)


def test_blocks_copy_only_the_edges(bars):
    b = in_blocks(bars, back=100, ahead=20, rows=1000)
    counts = b.df.where("symbol = 'a'").groupBy("blk").agg(F.count("*").alias("k"), F.sum(F.col("in_core").cast("int")))
    got = {r[0]: (r[1], r[2]) for r in counts.collect()}
    assert got == {0: (1020, 1000), **{k: (1120, 1000) for k in range(1, 6)}, 6: (1100, 1000)}


def test_one_exchange_and_one_sort_per_layout(bars):
    plan = sr.basic_indicators(bars)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1


def test_rolling_equals_pandas(bars, bars_frame):
    outputs = {
        f"{kind}{size}": (kind, "close", size, None) for kind in ("mean", "sum", "min", "max", "std") for size in (5, 50)
    }
    outputs["early"] = ("mean", "volume", 20, 1)
    got = collected(sr.rolling(bars, outputs))
    for name, (kind, source, size, need) in outputs.items():
        want = bars_frame.groupby("symbol")[source].transform(lambda x: getattr(x.rolling(size, min_periods=need), kind)())
        np.testing.assert_allclose(got[name], want, rtol=1e-7, atol=1e-6)


def test_extremes_of_any_size_equal_pandas(bars, bars_frame):
    sizes = (1, 2, 15, 16, 17, 31, 32, 33, 72, 96, 192, 255, 256, 257, 2000)
    outputs = {f"{kind}{size}": (kind, column, size, None) for kind, column in (("max", "high"), ("min", "low")) for size in sizes}
    outputs |= {"early": ("max", "gaps", 40, 1), "some": ("min", "gaps", 300, 25)}
    holes = bars.withColumn("gaps", F.when(F.col("rn") % 7 > 2, F.col("close")))
    got = collected(sr.rolling(holes, outputs))
    frame = bars_frame.assign(gaps=bars_frame["close"].where(bars_frame["rn"] % 7 > 2))
    for name, (kind, source, size, need) in outputs.items():
        want = frame.groupby("symbol")[source].transform(lambda x: getattr(x.rolling(size, min_periods=need), kind)())
        pd.testing.assert_series_equal(got[name], want, check_names=False, obj=name)


def test_weighted_hull_and_rank_equal_pandas(bars, bars_frame):
    got = collected(sr.weighted_means(bars, "close", [4, 10], [9]))

    def wma(x, n):
        w = np.arange(1, n + 1)
        return x.rolling(n).apply(lambda v: np.dot(v, w) / w.sum(), raw=True)

    close = bars_frame.groupby("symbol")["close"]
    for n in (4, 10):
        np.testing.assert_allclose(got[f"wma{n}"], close.transform(lambda x: wma(x, n)), rtol=1e-11)
    hull = close.transform(lambda x: wma(2 * wma(x, 4) - wma(x, 9), 3))
    np.testing.assert_allclose(got["hull9"], hull, rtol=1e-11)
    some = bars.withColumn("whole", F.round("close", 0))
    ranks = collected(sr.percent_rank(some, "whole", 100, "place"))
    want = bars_frame["close"].round(0).groupby(bars_frame["symbol"]).transform(lambda x: x.rolling(100).rank(pct=True))
    np.testing.assert_allclose(ranks["place"], want)


def test_running_and_forward_fill_over_tiles(bars, bars_frame):
    tile = F.floor(F.col("rn") / 37)
    got = collected(running(bars, tile, ["rn"], sums={"s": F.col("volume")}, maxima={"m": F.col("close")}))
    by = bars_frame.groupby("symbol")
    np.testing.assert_allclose(got["s"], by["volume"].cumsum())
    np.testing.assert_allclose(got["m"], by["close"].cummax())
    holes = bars.withColumn("x", F.when((F.col("rn") % 501) == 40, F.col("close")))
    filled = collected(forward_fill(holes, ["x"], tile, ["rn"]))
    want = bars_frame["close"].where(bars_frame["rn"] % 501 == 40).groupby(bars_frame["symbol"]).ffill()
    pd.testing.assert_series_equal(filled["x"], want, check_names=False)


@pytest.mark.parametrize("start", [False, True])
def test_drawdown_of_tiles_equals_the_whole(spark, start):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"k": rng.integers(0, 3, 3000), "rn": np.arange(3000), "r": rng.normal(0, 0.03, 3000)})
    df = spark.createDataFrame(frame)
    got = max_drawdown(df, 1.0 + F.col("r"), F.floor(F.col("rn") / 11), ["rn"], ["k"], start).toPandas()
    for _, row in got.iterrows():
        curve = (1 + frame.loc[frame["k"] == row["k"], "r"]).cumprod().to_numpy()
        curve = np.concatenate([[1.0], curve]) if start else curve
        want = (curve / np.maximum.accumulate(curve) - 1).min()
        assert row["max_drawdown"] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("q", [0.0, 0.5, 0.99, 1.0])
def test_quantile_equals_numpy(spark, q):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"k": rng.integers(0, 4, 5000), "x": np.round(rng.normal(0, 1, 5000), 2)})
    frame.loc[frame["k"] == 1, "x"] = 7.0
    frame = pd.concat([frame, pd.DataFrame({"k": [9], "x": [-3.25]})])
    got = exact_quantile(spark.createDataFrame(frame), ["k"], "x", q, "v").toPandas().set_index("k")["v"]
    want = frame.groupby("k")["x"].quantile(q)
    np.testing.assert_allclose(got.loc[want.index], want, atol=1e-12)


def test_quantiles_at_any_scale_and_in_one_pass(spark):
    rng = np.random.default_rng(16)
    parts = {
        "tiny": rng.normal(0, 1e-12, 3000),
        "huge": rng.normal(0, 1e12, 3000),
        "both": np.concatenate([rng.normal(0, 1e-12, 1501), rng.normal(0, 1e12, 1500)]),
        "ulps": np.nextafter(1.0, 2.0) + np.arange(1000) * np.finfo(float).eps,
        "ends": np.array([-np.inf, -1.0, 0.0, -0.0, 5e-324, np.inf, 1.7e308]),
        "two": np.array([3.0, 8.0]),
        None: np.array([2.5]),
    }
    frame = pd.DataFrame([(k, float(x)) for k, xs in parts.items() for x in xs], columns=["k", "x"])
    rows = spark.createDataFrame([(k, x) for k, x in zip(frame["k"], frame["x"])] + [("two", None), ("none", None)], "k string, x double")
    wanted = {"low": 0.0, "a": 0.13, "mid": 0.5, "p99": 0.99, "top": 1.0}
    got = {r["k"]: r for r in exact_quantiles(rows, ["k"], "x", wanted).collect()}
    assert set(got) == set(parts)
    for k, xs in parts.items():
        for name, q in wanted.items():
            ordered = np.sort(xs)
            rank = (len(xs) - 1) * q
            low, high = ordered[int(np.floor(rank))], ordered[int(np.ceil(rank))]
            want = low if low == high else low + (high - low) * (rank - np.floor(rank))
            assert got[k][name] == want or (np.isnan(want) and np.isnan(got[k][name])), (k, name)


def test_drawdown_takes_losses_beyond_everything_and_leaves_null_out(spark):
    from pyspark.sql import functions as F

    from barloom.plans.scan import max_drawdown

    factors = {"deep": [1.1, -0.5, 1.2], "null": [1.1, None, 0.9], "flat": [1.0, 1.1], "zero": [2.0, 0.0, 3.0]}
    rows = [(k, i, f) for k, fs in factors.items() for i, f in enumerate(fs)]
    df = spark.createDataFrame(rows, "k string, rn long, f double")
    for tile in (1, 2, 100):
        got = {r["k"]: r["max_drawdown"] for r in max_drawdown(df, F.col("f"), F.floor(F.col("rn") / tile), ["rn"], ["k"]).collect()}
        want = {"deep": -0.66 / 1.1 - 1, "null": -0.1, "flat": 0.0, "zero": -1.0}
        assert all(abs(got[k] - v) < 1e-12 for k, v in want.items()), got
