"""The 18 model inputs and the horizon label they are paired with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.config import KEYS, LOOKAHEAD_BARS, MAX_RETURN_PCT
from barloom.functions.scalar import clip as clip_column
from barloom.functions.text import (
    calendar_cycle,
    change_pct,
    clip,
    div,
    filled,
    finite_or,
    larger,
    ratio,
    sdiv,
    smaller,
    zero_to_null,
)
from barloom.operators import indicators as ind
from barloom.plans.blocks import POS, TOTAL, Blocked, in_blocks

ALPHAS = [ind.span(n) for n in (9, 12, 21, 26, 50)] + [ind.wilder(14)]
BACK = max(ind.reach(ind.span(50)), ind.reach(ind.span(26), ind.span(9)), ind.reach(ind.wilder(14))) + 1


def add_model_features(b: Blocked, finite: bool = True) -> Blocked:
    """Append the model inputs; warm-up values are filled as the model expects them.

    Prices that reach 0 or below give infinite and NaN values (a logarithm of a negative ratio); they are filled like
    missing ones, or kept without `finite`.
    """
    b = b.with_columns(
        {
            **ind.previous_bar(b),
            "_c6": b.lag("close", 6),
            "_mid": b.roll("avg", "close", 20, skip=0),
            "_std": b.roll("stddev_samp", "close", 20, skip=0),
            "_v20": b.roll("avg", "volume", 20, min_periods=1),
        }
    )
    b = b.with_columns({**ind.moves(), "_rng": zero_to_null("high - low")})
    b = b.ewm({"_atr": ind.atr_request(), **ind.ema_requests(9, 12, 21, 26, 50), **ind.rsi_requests(14)})
    b = b.ewm({"_sig": ind.macd_signal_request()})
    upper, lower = ind.bollinger("_mid", "_std")
    raw = {
        "body_pct": (div("abs(close - open)", "_rng"), 0.0, True),
        "upper_shadow_pct": (div(f"high - {larger('open', 'close')}", "_rng"), 0.0, True),
        "lower_shadow_pct": (div(f"{smaller('open', 'close')} - low", "_rng"), 0.0, True),
        "natr": (f"{ratio('_atr', 'close')} * 100", 0.0, False),
        "candle_vs_atr": (div("_rng", "_atr"), 1.0, False),
        "log_return_1": ("_lr1", 0.0, False),
        "roc_6": (f"({ratio('close', '_c6')} - 1) * 100", 0.0, False),
        "dist_ema_21_pct": (change_pct("close", "_ema21"), 0.0, False),
        "ema_9_21_spread_pct": (change_pct("_ema9", "_ema21"), 0.0, False),
        "dist_ema_50_pct": (change_pct("close", "_ema50"), 0.0, False),
        "macd_hist_pct": (f"{ratio(f'{ind.MACD_LINE} - _sig', 'close')} * 100", 0.0, False),
        "rsi_14": (ind.rsi(14), 50.0, False),
        "bb_position": (sdiv(f"close - {lower}", f"{upper} - {lower}"), 0.5, True),
        "volume_ratio_20": (sdiv("volume", "_v20"), 1.0, False),
    }
    fill = finite_or if finite else filled
    inputs = {}
    for name, (text, default, unit) in raw.items():
        value = fill(text, default)
        inputs[name] = clip(value, 0.0, 1.0) if unit else value
    return b.with_columns({**inputs, **calendar_cycle("ts")}).drop_scratch()


def model_features(
    bars: DataFrame, keys: tuple[str, ...] = KEYS, rows: int | None = None, finite: bool = True
) -> DataFrame:
    """Numbered bars -> bars with the 18 inputs, one exchange."""
    extra = {} if rows is None else {"rows": rows}
    return add_model_features(in_blocks(bars, back=BACK, alphas=ALPHAS, keys=keys, **extra), finite).core()


def add_horizon_label(b: Blocked, lookahead: int = LOOKAHEAD_BARS) -> Blocked:
    """Largest move up and down within the next `lookahead` bars, in percent of the close, as FLOAT.

    The tail of a series uses the bars that exist and is flagged invalid.
    """
    b = b.with_columns({"_top": b.forward("max", "high", lookahead), "_bottom": b.forward("min", "low", lookahead)})

    def move(diff: str) -> str:
        percent = f"coalesce(case when close > 0 then {div(diff, 'close')} * 100 end, 0D)"
        return f"float({clip(percent, 0.0, 100.0)})"

    b = b.with_columns({"upside_max_return": move("_top - close"), "downside_max_return": move("close - _bottom")})
    larger_move = "if(upside_max_return >= downside_max_return, upside_max_return, -downside_max_return)"
    return b.with_columns(
        {"max_return": larger_move, "horizon_label_valid": f"{POS} < {TOTAL} - {lookahead}"}
    ).drop("_top", "_bottom")


def horizon_labels(bars: DataFrame, lookahead: int = LOOKAHEAD_BARS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return add_horizon_label(in_blocks(bars, ahead=lookahead, keys=keys), lookahead).core()


def direction_targets(labeled: DataFrame, cap: float = MAX_RETURN_PCT) -> DataFrame:
    """Capped targets `y_up`, `y_dn` and `y_dir` (1 when the move up is at least the move down)."""
    up = clip_column(F.col("upside_max_return").cast("double"), 0.0, cap).cast("float")
    down = clip_column(F.col("downside_max_return").cast("double"), 0.0, cap).cast("float")
    out = labeled.withColumns({"y_up": up, "y_dn": down})
    return out.withColumn("y_dir", F.when(F.col("y_up") >= F.col("y_dn"), 1.0).otherwise(0.0).cast("float"))


def labeled_features(
    bars: DataFrame, lookahead: int = LOOKAHEAD_BARS, keys: tuple[str, ...] = KEYS, finite: bool = True
) -> DataFrame:
    """Inputs, horizon label and targets of the bars with a full look-ahead, behind one exchange.

    The features are causal, so dropping the unlabeled tail after computing them changes nothing.
    """
    b = in_blocks(bars, back=BACK, ahead=lookahead, alphas=ALPHAS, keys=keys)
    b = add_model_features(add_horizon_label(b, lookahead), finite)
    return direction_targets(b.core().where("horizon_label_valid"))


