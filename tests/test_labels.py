import numpy as np
import pytest

from barloom.config import BarrierParams, ConfirmParams
from barloom.operators import labels as lb
from barloom.plans.blocks import in_blocks
from barloom.plans.touch import ahead_of
from conftest import SCHEMA, collected, walk


def first_exit(path, entry, tp, sl, sign):
    """Sequential walk: (code, gross, step, price) of one trade; path rows are (high, low, close)."""
    up, down = entry * (1 + sign * tp / 100), entry * (1 - sign * sl / 100)
    for step, (high, low, _) in enumerate(path, start=1):
        stop = low <= down if sign == 1 else high >= down
        goal = high >= up if sign == 1 else low <= up
        if stop:
            return "SL", -sl, step, down
        if goal:
            return "TP", tp, step, up
    last = path[-1][2]
    return "TIMEOUT", sign * (last - entry) / entry * 100, 20, last


@pytest.fixture(scope="module")
def some(bars):
    return bars.where("symbol != 'a'")


def paths(frame):
    return frame[["high", "low", "close"]].to_numpy()


def test_outcomes_equal_a_bar_by_bar_walk(some, bars_frame):
    params = BarrierParams()
    got = lb.barrier_outcomes(some, params).toPandas()
    assert len(got) > 1500
    for symbol, part in got.groupby("symbol"):
        series = bars_frame[bars_frame["symbol"] == symbol].reset_index(drop=True)
        rows = paths(series)
        for r in part.itertuples():
            sign = 1 if r.direction_name == "LONG" else -1
            entry = series["open"][r.rn + 1] * (1 + sign * 0.0002)
            want = first_exit(rows[r.rn + 1 : r.rn + 21], entry, r.take_profit_pct, r.stop_loss_pct, sign)
            assert r.exit_reason == want[0] and r.bars_to_exit == want[2]
            assert r.gross_return_pct == pytest.approx(want[1], abs=1e-9)
            assert r.exit_price == pytest.approx(want[3], abs=1e-9)


def test_best_label_equals_a_search_of_the_grid(some, bars_frame):
    params = BarrierParams()
    got = collected(lb.trade_labels(some, params, use_sma_filter=False))
    vol = collected(lb.add_volatility(lb.in_blocks(some, back=800, alphas=[1 / 14]), params).core())
    checked = 0
    for symbol, part in got.groupby("symbol"):
        series = bars_frame[bars_frame["symbol"] == symbol].reset_index(drop=True)
        states = vol[vol["symbol"] == symbol].reset_index(drop=True)
        rows = paths(series)
        for r in part.itertuples():
            best = (0.0, 1, 0.0, 0)
            atr, level = states["atr_pct"][r.rn], states["atr_level"][r.rn]
            if r.rn < r.n - 20 and atr > 0 and level <= 2:
                for tp_m in params.tp_multipliers:
                    for sl_m in params.sl_multipliers:
                        tp, sl = np.clip(atr * tp_m, 0.1, 10), np.clip(atr * sl_m, 0.05, 5)
                        free = 0.1 < atr * tp_m < 10 and 0.05 < atr * sl_m < 5
                        if (tp_m < 1.5 * sl_m) if free else (tp / max(sl, 1e-9) < 1.5):
                            continue
                        for side, sign in ((0, 1), (2, -1)):
                            entry = series["open"][r.rn + 1] * (1 + sign * 0.0002)
                            code, gross, step, _ = first_exit(rows[r.rn + 1 : r.rn + 21], entry, tp, sl, sign)
                            if code == "TP" and gross - params.cost_pct > best[0] + 1e-12:
                                best = (gross - params.cost_pct, side, tp, step)
            assert (r.direction_label, r.bars_to_exit) == (best[1], best[3])
            assert r.net_return_pct == pytest.approx(best[0], abs=1e-9)
            checked += best[1] != 1
    assert checked > 100


def test_stop_wins_when_one_bar_touches_both(spark):
    frame = walk("x", 60, 1)
    frame[["open", "high", "low", "close"]] = 100.0
    frame["high"], frame["low"] = 100.5, 99.5
    frame.loc[31, "high"], frame.loc[31, "low"] = 102.0, 98.0
    got = lb.barrier_outcomes(spark.createDataFrame(frame, SCHEMA)).toPandas()
    row = got[(got["rn"] == 30) & (got["direction_name"] == "LONG")].iloc[0]
    assert row["exit_reason"] == "SL" and row["bars_to_exit"] == 1


def test_confirmation_rejects_and_keeps_the_original(bars):
    labeled = lb.label_bars(
        bars.where("symbol = 'b'"), confirm_params=ConfirmParams(enabled=True, min_score=12), groups=("averages", "technical")
    )
    got = collected(labeled)
    rejected = got[~got["label_filter_reason"].isin(["oracle_neutral", "confirmed"])]
    assert len(rejected) and (rejected["direction_label"] == 1).all() and (rejected["net_return_pct"] == 0).all()
    assert (rejected["oracle_direction_label"] != 1).all() and rejected["entry_price"].isna().all()
    kept = got[got["label_filter_reason"] == "confirmed"]
    assert len(kept) and (kept["confirmation_score"] >= 12).all() and (kept["confirmation_edge"] >= 3).all()


def test_ratio_is_decided_on_decimals():
    """Equal ratios count whatever the last bit of the volatility; bounded sides are compared as they are."""
    params = BarrierParams()

    def accepts(target, stop, atr):
        text = lb.ratio_test(target, stop, params).replace("atr_pct", repr(atr)).replace("D", "")
        return eval(text.replace("true", "True").replace("false", "False"))  # numbers, comparisons, and/or

    rng = np.random.default_rng(0)
    for atr in rng.uniform(0.2, 3.0, 500):
        assert accepts(1.5, 1.0, atr) and accepts(3.0, 1.0, atr) and not accepts(1.0, 0.75, atr)
    for target in params.tp_multipliers:
        for stop in params.sl_multipliers:
            for atr in 10.0 ** rng.uniform(-4, 3, 300):
                tp, sl = np.clip(atr * target, 0.1, 10), np.clip(atr * stop, 0.05, 5)
                if abs(tp / sl - 1.5) > 1e-9:
                    assert accepts(target, stop, atr) == (tp / sl >= 1.5), (target, stop, atr)
    assert lb.ratio_test(1.0, 0.5, BarrierParams(min_rr=0.0)) == "((true))"


@pytest.mark.parametrize("lookahead", [1, 2, 20, 2000])
def test_first_touch_at_any_distance(some, bars_frame, lookahead):
    """Barriers near and far, for look-aheads beyond the series, equal a walk over the bars."""
    params = BarrierParams(lookahead=lookahead, fixed_tp_multiplier=6.0, fixed_sl_multiplier=5.0, max_stop_pct=50.0, max_target_pct=50.0)
    got = lb.barrier_outcomes(some, params).toPandas()
    for symbol, part in got.groupby("symbol"):
        series = bars_frame[bars_frame["symbol"] == symbol].reset_index(drop=True)
        high, low, close = (series[c].to_numpy() for c in ("high", "low", "close"))
        for r in part.itertuples():
            sign = 1 if r.direction_name == "LONG" else -1
            up, down = (r.entry_price * (1 + sign * s * p / 100) for s, p in ((1, r.take_profit_pct), (-1, r.stop_loss_pct)))
            ahead = slice(r.rn + 1, r.rn + 1 + lookahead)
            goal = np.flatnonzero(high[ahead] >= up if sign == 1 else low[ahead] <= up)
            stop = np.flatnonzero(low[ahead] <= down if sign == 1 else high[ahead] >= down)
            first = lambda hits: hits[0] + 1 if len(hits) else np.inf
            t, s = first(goal), first(stop)
            want = ("SL", s, down) if s <= t and s < np.inf else ("TP", t, up) if t < np.inf else ("TIMEOUT", lookahead, close[ahead][-1])
            assert (r.exit_reason, r.bars_to_exit) == want[:2]
            assert r.exit_price == pytest.approx(want[2], rel=1e-12)


def test_touch_work_grows_with_the_logarithm(some):
    """No window frame as long as the look-ahead is left in the plan."""
    plan = lb.barrier_outcomes(some, BarrierParams(lookahead=2000))._jdf.queryExecution().analyzed().toString().lower()
    assert "rowframe, 1, 2000" not in plan
    b = in_blocks(some, ahead=2000)
    assert [ahead_of(b, k).levels for k in (1, 20, 2000)] == [1, 5, 11]


def test_filters_share_their_grid(some):
    both = lb.trade_labels_by_filter(some, {"on": True, "off": False})
    for name, used in (("on", True), ("off", False)):
        want = collected(lb.trade_labels(some, use_sma_filter=used))
        got = collected(both.where(f"scenario = '{name}'").drop("scenario"))
        assert got[want.columns].equals(want)


def test_modes_are_validated(some):
    with pytest.raises(ValueError):
        lb.trade_labels(some, mode="other")
    with pytest.raises(ValueError):
        lb.trade_labels(some, entry_mode="other")
    with pytest.raises(ValueError):
        lb.trade_labels(some, keep_all_outcomes=True)


def test_required_flags_reject_before_the_score_is_looked_at(bars):
    need = ConfirmParams(enabled=True, required_bull=("condition_roc12_positive", "absent"), required_bear=("price_above_ema20",))
    got = collected(lb.label_bars(bars.where("symbol = 'b'"), confirm_params=need, groups=("averages", "technical")))
    reason = got["label_filter_reason"]
    long, short = got["oracle_direction_label"] == 0, got["oracle_direction_label"] == 2
    fails = (long & ~got["condition_roc12_positive"].fillna(False).astype(bool)) | (short & got["price_above_ema20"].fillna(False).astype(bool))
    missing = reason == "missing_required_trend_confirmation"
    assert missing.any() and (got.loc[missing, "direction_label"] == 1).all()
    earlier = reason.isin(["invalid_lookahead_window", "non_positive_return"])
    assert (missing == (fails & ~earlier)).all()
