"""Codes, column names and flag lists that outputs are known by."""

from __future__ import annotations

LONG, NEUTRAL, SHORT = 0, 1, 2
EXIT_TP, EXIT_SL, EXIT_TIMEOUT, EXIT_NONE = 0, 1, 2, 3
DIRECTION_NAMES = {LONG: "LONG", NEUTRAL: "NEUTRAL", SHORT: "SHORT"}
EXIT_NAMES = {EXIT_TP: "TP", EXIT_SL: "SL", EXIT_TIMEOUT: "TIMEOUT", EXIT_NONE: "NONE"}

# Seconds per candle interval.
INTERVAL_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1D": 86400}

# Moving averages of the status table, as kind and period.
MOVING_AVERAGES = {
    "sma20": ("sma", 20),
    "sma50": ("sma", 50),
    "sma200": ("sma", 200),
    "ema5": ("ema", 5),
    "ema9": ("ema", 9),
    "ema20": ("ema", 20),
    "ema50": ("ema", 50),
    "ema200": ("ema", 200),
    "hma9": ("hma", 9),
    "hma21": ("hma", 21),
    "hma50": ("hma", 50),
}

MODEL_FEATURES = (
    "body_pct",
    "upper_shadow_pct",
    "lower_shadow_pct",
    "natr",
    "candle_vs_atr",
    "log_return_1",
    "roc_6",
    "dist_ema_21_pct",
    "ema_9_21_spread_pct",
    "dist_ema_50_pct",
    "macd_hist_pct",
    "rsi_14",
    "bb_position",
    "volume_ratio_20",
    "hour_sin",
    "hour_cos",
    "dow_sin",
    "dow_cos",
)

CONTEXT_FEATURES = (
    "log_return_1",
    "natr",
    "dist_ema_9",
    "dist_ema_21",
    "dist_ema_50",
    "ema_9_21_spread",
    "ema_21_50_spread",
    "trend_regime",
    "rsi_14",
    "rsi_slope_7_21",
    "adx",
    "bb_position",
    "volume_surprise",
)

CONFIDENCE_EDGES = (0.50, 0.55, 0.60, 0.65, 1.01)
MAGNITUDE_EDGES = (0.0, 0.5, 1.0, 1.5, float("inf"))

# Columns that carry information from later bars.
HORIZON_LABEL_COLUMNS = ("upside_max_return", "downside_max_return", "max_return", "horizon_label_valid")
TRADE_LABEL_COLUMNS = (
    "direction_label",
    "take_profit_pct",
    "stop_loss_pct",
    "expected_return_pct",
    "time_to_target",
    "magnitude_label",
    "entry_price",
    "exit_price",
    "exit_reason",
    "bars_to_exit",
    "trade_return_pct",
    "gross_return_pct",
    "net_return_pct",
    "direction_name",
    "sma_filter_used",
    "labeling_mode",
    "entry_mode",
    "rr_ratio",
    "label_valid",
    "oracle_direction_label",
    "oracle_direction_name",
    "confirmation_score",
    "confirmation_bull_score",
    "confirmation_bear_score",
    "confirmation_edge",
    "confirmation_filter_used",
    "label_filter_reason",
)

# Distances that repeat `dist_*_pct` on another scale, and columns that add nothing to a model.
REPEATED_DISTANCES = ("dist_ema_5", "dist_ema_9", "dist_ema_20", "dist_ema_50", "dist_hma_9", "dist_hma_21")
LOW_VALUE_COLUMNS = ("vwap", "vol_percentile_100", "ema21")

# Flags that speak for a long or a short trade; those in BEAR_INVERTED count when false.
BULL_FLAGS = (
    "price_above_ema5",
    "price_above_ema9",
    "price_above_ema20",
    "price_above_hma9",
    "condition_ema5_above_ema20",
    "condition_ema5_cross_above_ema20",
    "condition_ema9_above_ema21",
    "condition_hma9_above_hma21",
    "condition_hma9_cross_above_hma21",
    "condition_trend_regime_up",
    "condition_macd_bullish",
    "condition_macd_hist_positive",
    "condition_dmp_above_dmn",
    "condition_rsi_rising",
    "condition_momentum_up",
    "condition_roc3_positive",
    "condition_roc12_positive",
    "condition_above_vwap",
    "condition_obv_rising",
    "condition_mtf_4h_trend_up",
    "condition_mtf_4h_rsi_bullish",
)
BEAR_FLAGS = (
    "price_above_ema5",
    "price_above_ema9",
    "price_above_ema20",
    "price_above_hma9",
    "condition_ema5_above_ema20",
    "condition_ema5_cross_below_ema20",
    "condition_hma9_cross_below_hma21",
    "condition_trend_regime_down",
    "condition_macd_bearish",
    "condition_macd_hist_negative",
    "condition_dmn_above_dmp",
    "condition_rsi_falling",
    "condition_momentum_down",
    "condition_roc3_negative",
    "condition_roc12_negative",
    "condition_below_vwap",
    "condition_obv_falling",
    "condition_mtf_4h_trend_down",
    "condition_mtf_4h_rsi_bearish",
)
BEAR_INVERTED = frozenset(
    {
        "price_above_ema5",
        "price_above_ema9",
        "price_above_ema20",
        "price_above_hma9",
        "condition_ema5_above_ema20",
    }
)
