import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.config import TradeParams
from barloom.operators import evaluate as ev
from barloom.operators import reports as rp
from barloom.operators import trades as td
from conftest import SCHEMA, collected, walk


def greedy(frame):
    free, out = -1, []
    for r in frame.sort_values("rn").itertuples():
        if r.rn >= free:
            out.append(r.rn)
            free = r.exit_rn + 1
    return out


@pytest.mark.parametrize("kind", ["mixed", "always_longest", "sparse"])
def test_selection_equals_a_sequential_pass(spark, monkeypatch, kind):
    monkeypatch.setattr(td, "CHUNK", 32)
    rng = np.random.default_rng(3)
    parts = []
    for symbol, n in (("a", 6000), ("b", 700), ("c", 1)):
        rn = np.arange(n) if kind != "sparse" else np.sort(rng.choice(n * 9, n, replace=False))
        hold = np.full(n, 20) if kind == "always_longest" else rng.integers(1, 21, n)
        parts.append(pd.DataFrame({"symbol": symbol, "scenario": "s", "rn": rn, "exit_rn": rn + hold, "x": rn * 2.0}))
    frame = pd.concat(parts, ignore_index=True)
    got = td.non_overlapping(spark.createDataFrame(frame), 20, ["symbol", "scenario"]).toPandas()
    for symbol, part in frame.groupby("symbol"):
        mine = got[got["symbol"] == symbol].sort_values("rn")
        assert list(mine["rn"]) == greedy(part)
        assert (mine["x"] == mine["rn"] * 2.0).all()


def predictions(spark, n=1500, seed=8):
    frame = walk("x", n, seed)
    rng = np.random.default_rng(seed)
    extra = pd.DataFrame(
        {
            "p_up": np.where(np.arange(n) % 11 == 0, np.nan, rng.random(n)),
            "up_pred": rng.random(n) * 2,
            "dn_pred": rng.random(n) * 2,
            "y_up": rng.random(n),
            "y_dn": rng.random(n),
        }
    )
    df = spark.createDataFrame(
        pd.concat([frame, extra], axis=1),
        SCHEMA + ", p_up double, up_pred double, dn_pred double, y_up double, y_dn double",
    )
    return df.withColumn("p_up", F.nanvl("p_up", F.lit(None))), pd.concat([frame, extra], axis=1)


def account(rows, p):
    """Bar by bar account of one scenario."""
    equity, bar, out = p.initial_capital, 0, []
    while bar < len(rows) - 1:
        r = rows[bar]
        up = r.p_up >= 0.5
        move = r.up_pred if up else r.dn_pred
        if not r.p_up == r.p_up or max(r.p_up, 1 - r.p_up) < p.confidence or move < p.min_move:
            bar += 1
            continue
        sign, entry = (1 if up else -1), rows[bar + 1].open
        tp, sl = entry * (1 + sign * move * p.tp_fraction / 100), entry * (1 - sign * move * p.sl_fraction / 100)
        last = min(bar + p.max_hold, len(rows) - 1)
        exit_bar, price, reason = last, rows[last].close, "TIME"
        for k in range(bar + 1, last + 1):
            if (rows[k].low <= sl) if up else (rows[k].high >= sl):
                exit_bar, price, reason = k, sl, "SL"
                break
            if (rows[k].high >= tp) if up else (rows[k].low <= tp):
                exit_bar, price, reason = k, tp, "TP"
                break
        net = (price - entry) / entry * sign - p.round_trip_cost
        equity += equity * p.position_fraction * net
        out.append((bar, reason, exit_bar - bar, equity))
        bar = exit_bar + 1
        if equity <= p.ruin_equity:
            break
    return out


def test_backtest_equals_a_bar_by_bar_account(spark):
    sweep = (TradeParams(), TradeParams(name="five", max_hold=5), TradeParams(name="ruin", fee_pct=5.0, ruin_equity=60.0))
    df, frame = predictions(spark)
    got = td.backtest(df, sweep).toPandas()
    rows = list(frame.itertuples())
    for p in sweep:
        mine = got[got["scenario"] == p.name].sort_values("rn")
        want = account(rows, p)
        assert list(zip(mine["rn"], mine["exit_reason"], mine["hold_bars"])) == [w[:3] for w in want]
        np.testing.assert_allclose(mine["equity"], [w[3] for w in want], rtol=1e-10)
    ruined = got[got["scenario"] == "ruin"].sort_values("rn")
    assert ruined["equity"].iloc[-1] <= 60 and (ruined["equity"].iloc[:-1] > 60).all()
    assert set(got["exit_reason"]) == {"TP", "SL", "TIME"}


def test_trades_never_overlap_and_reports_add_up(spark):
    df, _ = predictions(spark, seed=9)
    trades = td.backtest(df).cache()
    rows = collected(trades)
    assert (rows["rn"].iloc[1:].to_numpy() > rows["exit_rn"].iloc[:-1].to_numpy()).all()
    exits = rp.exit_breakdown(trades).toPandas()
    assert len(exits) == 3 and exits["trades"].sum() == len(rows)
    sides = rp.direction_on_trades(trades).toPandas().set_index("side")["trades"]
    assert sides["ALL"] == sides["LONG"] + sides["SHORT"] == len(rows)
    curve = collected(td.equity_curve(trades), ("symbol", "trade_no"))
    assert list(curve["trade_no"]) == list(range(len(rows) + 1)) and curve["equity"].iloc[0] == 100.0
    summary = rp.capital_summary(trades, df).toPandas().iloc[0]
    assert summary["max_drawdown_pct"] == pytest.approx(curve["drawdown"].min() * 100)
    assert summary["final_capital"] == pytest.approx(rows["equity"].iloc[-1])
    histogram = rp.pnl_histogram(trades).toPandas()
    assert histogram["wins"].sum() + histogram["losses"].sum() == len(rows)
    assert sorted(histogram["bin"]) == list(range(rp.PNL_BINS))
    stats = rp.trade_stats(trades, rp.traded_span(df)).toPandas().iloc[0]
    assert stats["trades"] == len(rows) == stats["wins"] + stats["losses"]
    assert rp.last_trades(trades).count() == min(10, len(rows))


def test_accounts_without_trades_keep_their_capital(spark):
    df, _ = predictions(spark, seed=9)
    sweep = (TradeParams(), TradeParams(name="idle", confidence=1.5, initial_capital=250.0))
    trades, opened = td.backtest(df, sweep).cache(), td.accounts(df, sweep)
    assert set(trades.toPandas()["scenario"]) == {"base"}
    curve = td.equity_curve(trades, opened=opened).where("scenario = 'idle'").toPandas()
    assert curve[["trade_no", "equity", "peak", "drawdown"]].values.tolist() == [[0, 250.0, 250.0, 0.0]]
    summary = rp.capital_summary(trades, df, opened=opened).toPandas().set_index("scenario")
    idle = summary.loc["idle"]
    assert (idle["start_capital"], idle["final_capital"], idle["trades"]) == (250.0, 250.0, 0)
    assert (idle["total_return_pct"], idle["max_drawdown_pct"], idle["trades_per_day"]) == (0.0, 0.0, 0.0)
    assert summary.loc["base", "trades"] == trades.count()
    none = trades.where("false")
    assert rp.capital_summary(none, df, opened=opened).count() == 2
    assert rp.pnl_histogram(none).count() == 0


def test_histogram_lists_empty_bins(spark):
    rows = [("x", True, 1.0, 0.5)] * 3 + [("x", True, 2.0, 4.0)]
    got = ev.move_histogram(spark.createDataFrame(rows, "symbol string, correct boolean, pred_mag double, achieved_mag double"))
    got = got.toPandas()
    assert len(got) == 2 * ev.HISTOGRAM_BINS and got["n"].sum() == 3
    right, wrong = got[got["correct"]], got[~got["correct"]]
    assert wrong["n"].sum() == 0 and wrong["density"].isna().all()
    width = right["lo"].max() / (ev.HISTOGRAM_BINS - 1)
    assert right["density"].sum() * width == pytest.approx(1.0)


def test_evaluation_counts_add_up(spark):
    df, _ = predictions(spark, seed=10)
    rows = ev.evaluation_rows(df.where("p_up is not null")).cache()
    card = ev.direction_scorecard(rows).toPandas().iloc[0]
    assert card["n_pred_up"] + card["n_pred_down"] == card["n_total"]
    assert card["accuracy"] == pytest.approx((card["n_pred_up_correct"] + card["n_pred_down_correct"]) / card["n_total"])
    confidence = ev.confidence_buckets(rows).toPandas()
    assert len(confidence) == 4 and confidence["n"].sum() == card["n_total"]
    magnitude = ev.magnitude_buckets(rows).toPandas()
    assert len(magnitude) == 4 and magnitude["n"].sum() == card["n_total"]
    frame = rows.toPandas()
    pick = frame[(frame["pred_mag"] >= 0.5) & (frame["pred_mag"] < 1.0)]
    got = magnitude[magnitude["lo"] == 0.5].iloc[0]
    assert got["median_achieved"] == pytest.approx(pick["achieved_mag"].median())
    curve = ev.calibration(rows).toPandas()
    assert curve["n"].min() >= 20
    assert ((curve["lo"] <= curve["mean_p_up"]) & (curve["mean_p_up"] <= curve["hi"])).all()


def test_profit_factor_without_losses(spark):
    rows = [("x", i, 0, 1.0, 1.1, 2, 1.0, 0.5) for i in range(3)] + [("x", 3, 1, 0.0, 0.0, 0, 0.0, 0.0)]
    names = ["symbol", "rn", "direction_label", "net_return_pct", "gross_return_pct", "bars_to_exit", "take_profit_pct",
             "stop_loss_pct"]
    got = rp.label_stats(spark.createDataFrame(rows, names)).toPandas().iloc[0]
    assert got["profit_factor"] == float("inf") and got["max_drawdown_pct"] == 0.0 and got["win_rate_pct"] == 100.0
    none = spark.createDataFrame([("y", 0, 1, 0.0, 0.0, 0, 0.0, 0.0)], names)
    empty = rp.label_stats(none).toPandas().iloc[0]
    assert empty["profit_factor"] == 0.0 and empty["total_trades"] == 0 and empty["median_bars_to_exit"] == 0.0


def test_state_report_over_tiles_equals_a_plain_pass(spark, monkeypatch):
    monkeypatch.setattr(rp, "BLOCK_ROWS", 16)
    written = []
    monkeypatch.setattr(rp, "settle", lambda df, keep=rp.settle: written.append(df) or keep(df))
    rng = np.random.default_rng(12)
    n = 400
    frame = pd.DataFrame({"symbol": rng.choice(["a", "b"], n), "rn": np.arange(n), "direction_label": rng.integers(0, 3, n)})
    frame["net_return_pct"] = rng.normal(0.0, 20.0, n)
    frame.loc[frame["rn"] == 205, "net_return_pct"] = -150.0
    frame["gross_return_pct"], frame["bars_to_exit"] = frame["net_return_pct"] + 0.1, rng.integers(1, 20, n)
    flags = [f"condition_{x}" for x in ("often", "rare", "never")]
    for flag, share in zip(flags, (0.7, 0.02, 0.0)):
        frame[flag] = rng.random(n) < share
    df = spark.createDataFrame(frame).withColumn("condition_unknown", F.lit(None).cast("boolean"))
    df = df.withColumn("net_return_pct", F.when(F.col("rn") % 37 != 5, F.col("net_return_pct")))
    frame.loc[frame["rn"] % 37 == 5, "net_return_pct"] = np.nan
    got = rp.condition_report(df).toPandas().set_index(["symbol", "direction", "condition"])
    assert len(written) == 1 and set(written[0].columns) == {"symbol", "direction", "_tile", "_rows"}
    assert len(got) == 2 * 2 * 4 and got.xs("condition_unknown", level=2)["total_trades"].sum() == 0
    for (symbol, direction, flag), row in got.drop("condition_unknown", level=2).iterrows():
        code = rp.LONG if direction == "BUY" else rp.SHORT
        of = frame[(frame["symbol"] == symbol) & (frame["direction_label"] == code)]
        mine = of[of[flag]]
        net = mine["net_return_pct"]
        assert row["total_trades"] == len(mine)
        assert row["profitable_trades"] == (net > 0).sum()
        assert row["net_return_pct"] == pytest.approx(net.sum())
        assert row["avg_return_per_trade"] == pytest.approx(net.mean() if net.count() else 0.0)
        assert row["average_loss_pct"] == pytest.approx(net[net < 0].mean() if (net < 0).any() else 0.0)
        assert row["avg_bars_to_exit"] == pytest.approx(mine["bars_to_exit"].mean() if len(mine) else 0.0)
        curve = (1 + net.fillna(0.0) / 100).cumprod().to_numpy()
        fall = min(0.0, (curve / np.maximum.accumulate(curve) - 1).min()) if len(curve) else 0.0
        assert row["max_drawdown_pct"] == pytest.approx(fall * 100)
