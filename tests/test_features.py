import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.names import MODEL_FEATURES
from barloom.operators import model_features as mf
from barloom.operators import resample as rs
from barloom.operators import wide_features as wf
from conftest import SCHEMA, collected, walk


def same(a: pd.DataFrame, b: pd.DataFrame, columns) -> None:
    for name in columns:
        x, y = a[name], b[name]
        if x.dtype == bool:
            assert (x == y).all(), name
        else:
            np.testing.assert_allclose(x.astype(float), y.astype(float), rtol=1e-7, atol=1e-9, err_msg=name)


def test_model_features_do_not_depend_on_the_layout(bars):
    whole, cut = collected(mf.model_features(bars)), collected(mf.model_features(bars, rows=1))
    same(whole, cut, MODEL_FEATURES)


def test_wide_features_do_not_depend_on_the_layout(bars):
    whole, cut = collected(wf.wide_features(bars)), collected(wf.wide_features(bars, rows=1))
    names = [x for x in whole.columns if x not in ("symbol", "ts")]
    assert len(names) > 200
    same(whole, cut, names)


def test_features_are_causal(spark, bars_frame):
    cut = bars_frame[(bars_frame["symbol"] == "b") & (bars_frame["rn"] < 500)].assign(n=500)
    full = bars_frame[bars_frame["symbol"] == "b"]
    a = collected(wf.wide_features(spark.createDataFrame(cut, SCHEMA), ["technical", "structure"]))
    b = collected(wf.wide_features(spark.createDataFrame(full, SCHEMA), ["technical", "structure"]))
    same(a, b[b["rn"] < 500].reset_index(drop=True), [x for x in a.columns if x not in ("symbol", "ts", "n")])


def test_constant_price(spark):
    flat = walk("x", 300, 1)
    flat[["open", "high", "low", "close"]] = 50.0
    got = collected(wf.wide_features(spark.createDataFrame(flat, SCHEMA), ["averages", "technical"], False))
    last = got.iloc[-1]
    assert last["ema200"] == pytest.approx(50.0) and last["rsi_14"] == 0.0 and last["adx"] == 0.0
    assert pd.isna(last["body_pct_range"]) and last["bb_position"] == 0.0
    model = collected(mf.model_features(spark.createDataFrame(flat, SCHEMA))).iloc[-1]
    assert model["body_pct"] == 0.0 and model["candle_vs_atr"] == 1.0 and model["bb_position"] == 0.0


def test_fill_reaches_over_blocks(spark):
    """Bars without range for longer than a block: the last value before the gap is carried."""
    frame = walk("x", 9600, 4)
    gap = frame["rn"].between(4200, 9500)
    for name in ("open", "high", "low", "close"):
        frame.loc[gap, name] = 900.0
    df = spark.createDataFrame(frame, SCHEMA)
    raw = collected(wf.wide_features(df, ["technical"], False))
    got = collected(wf.filled_features(df, ["technical"], False, rows=1))
    for name in wf.RANGE_FEATURES:
        np.testing.assert_allclose(got[name], raw[name].ffill().fillna(0.0), rtol=1e-9, err_msg=name)
    assert not got.isna().any().any()


def test_coarse_bars_equal_pandas(bars, bars_frame):
    got = collected(rs.resample(bars, 4 * 3600), ("symbol", "ts"))
    rule = {"open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum"}
    parts = []
    for symbol, part in bars_frame.groupby("symbol"):
        coarse = part.set_index("ts").resample("4h", label="right", closed="right").agg(rule).dropna()
        parts.append(coarse.reset_index().assign(symbol=symbol))
    want = pd.concat(parts, ignore_index=True)
    assert (got["ts"] == want["ts"]).all()
    same(got, want, rule)


def test_context_is_the_last_finished_coarse_bar(spark, bars_frame):
    """As-of lookup by pandas on a series with holes."""
    part = bars_frame[(bars_frame["symbol"] == "b") & (bars_frame["rn"] % 7 != 3)].copy()
    part["rn"], part["n"] = np.arange(len(part)), len(part)
    got = collected(rs.with_context(spark.createDataFrame(part, SCHEMA)))
    rule = {"open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum"}
    coarse = part.set_index("ts").resample("4h", label="right", closed="right").agg(rule).dropna()
    ret = np.log(coarse["close"] / coarse["close"].shift(1)).shift(1)
    want = ret.reindex(part["ts"], method="ffill").reset_index(drop=True)
    np.testing.assert_allclose(got["mtf_4h_log_return_1"], want, rtol=1e-9)


def test_feature_columns_hold_no_labels_or_prices(bars):
    names = wf.feature_columns(mf.horizon_labels(wf.wide_features(bars)))
    assert not set(names) & {"close", "ema50", "max_return", "horizon_label_valid", "price_above_ema5", "vwap", "rn"}
    assert {"rsi_14", "dist_ema50_pct", "bos_bull_20", "mtf_1d_adx", "dist_ema_21"} <= set(names)
    assert not [x for x in names if x.startswith(("condition_", "slope_"))]


def test_horizon_label_by_hand(spark):
    frame = walk("x", 22, 1)
    frame[["open", "high", "low", "close"]] = 100.0
    frame.loc[7, "high"], frame.loc[12, "low"] = 150.0, 90.0
    got = collected(mf.horizon_labels(spark.createDataFrame(frame, SCHEMA)))
    first = got.iloc[0]
    assert (first["upside_max_return"], first["downside_max_return"], first["max_return"]) == (50.0, 10.0, 50.0)
    assert list(got["horizon_label_valid"]) == [True, True] + [False] * 20
    short = collected(mf.horizon_labels(spark.createDataFrame(walk("y", 20, 2), SCHEMA)))
    assert not short["horizon_label_valid"].any()


def test_flags_are_complete(bars):
    wide = wf.wide_features(bars, ["technical"])
    flags = [x for x in wide.columns if x.startswith("condition_")]
    assert len(flags) == 54
    assert wide.where(F.greatest(*[F.col(x).isNull().cast("int") for x in flags]) == 1).count() == 0
