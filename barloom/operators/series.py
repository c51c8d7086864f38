"""Single rolling, smoothing and running operators on numbered bars, each behind one exchange."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import KEYS
from barloom.functions.text import crossed_above, crossed_below, div, flag, ln, ratio, sdiv
from barloom.operators import indicators as ind
from barloom.plans.blocks import BLOCK_ROWS, POS, Ewm, Extreme, back, fits_blocks, in_blocks
from barloom.plans import scan
from barloom.plans.scan import forward_fill, running

ROLLING = {"mean": "avg", "sum": "sum", "min": "min", "max": "max", "std": "stddev_samp"}


def rolling(
    bars: DataFrame, outputs: dict[str, tuple[str, str, int, int | None]], keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """Rolling statistics: output -> (mean | sum | min | max | std, column, size, min_periods or None for size)."""
    b = in_blocks(bars, back=max(size for _, _, size, _ in outputs.values()), keys=keys)
    ends = {name: Extreme(kind, x, size, need) for name, (kind, x, size, need) in outputs.items() if kind in ("max", "min")}
    others = {name: b.roll(ROLLING[kind], x, size, min_periods=need) for name, (kind, x, size, need) in outputs.items() if name not in ends}
    rolled = b.extremes(ends).with_columns(others).core()
    return rolled.select(*[c for c in rolled.columns if c not in outputs], *outputs)


def changes(bars: DataFrame, column: str, lags: Iterable[int], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Difference, percent change and log return over k bars, for every k."""
    lags = list(lags)
    b = in_blocks(bars, back=max(lags), keys=keys)
    b = b.with_columns({f"_lag{k}": b.lag(column, k) for k in lags})
    out = {}
    for k in lags:
        before = f"_lag{k}"
        out[f"diff_{k}"] = f"{column} - {before}"
        out[f"pct_change_{k}"] = f"{ratio(column, before)} - 1"
        out[f"log_return_{k}"] = ln(ratio(column, before))
    return b.with_columns(out).drop_scratch().core()


def smoothed(
    bars: DataFrame, outputs: dict[str, tuple[str, float, int]], keys: tuple[str, ...] = KEYS, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Exponentially weighted means: output -> (column without missing values, weight of the newest, min_periods).

    Weights that forget within a few blocks are smoothed there; any other one makes it a scan over segments.
    """
    requests = {name: Ewm(x, alpha, need) for name, (x, alpha, need) in outputs.items()}
    alphas = [r.alpha for r in requests.values()]
    if not all(map(fits_blocks, alphas)):
        return scan.smoothed(bars, requests, keys)
    return in_blocks(bars, back=max(map(ind.reach, alphas)), alphas=alphas, keys=keys, rows=rows).ewm(requests).core()


def weighted_means(
    bars: DataFrame, column: str, weighted: Iterable[int], hull: Iterable[int], keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """Linearly weighted means `wma{n}` and Hull means `hull{n}` of a column without missing values."""
    weighted, hull = list(weighted), list(hull)
    longest = max([*weighted, *hull])
    steps = max((ind.hull_parts(n)[2] for n in hull), default=1)
    b = in_blocks(bars, back=longest + steps, keys=keys)
    b = b.with_columns({"_trail": b.trail(column, longest)})
    values = [column] + [back("_trail", k) for k in range(1, longest)]
    b = b.with_columns({f"wma{n}": ind.weighted_mean(values[:n]) for n in weighted})
    for n in hull:
        half, full, smooth = ind.hull_parts(n)
        raw = f"2 * {ind.weighted_mean(values[:half])} - {ind.weighted_mean(values[:full])}"
        b = b.with_columns({f"_raw{n}": raw})
        b = b.with_columns({f"_raw{n}_{k}": b.lag(f"_raw{n}", k) for k in range(1, smooth)})
        parts = [f"_raw{n}"] + [f"_raw{n}_{k}" for k in range(1, smooth)]
        b = b.with_columns({f"hull{n}": ind.weighted_mean(parts)})
    return b.drop_scratch().core()


def percent_rank(bars: DataFrame, column: str, size: int, out: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Average-rank percentile of each value among the last `size`; NULL until that many exist."""
    b = in_blocks(bars, back=size, keys=keys)
    b = b.with_columns({"_trail": b.trail(column, size)}).with_columns({"_sorted": "sort_array(_trail)"})
    text = f"case when size(_trail) = {size} then {ind.percent_rank_of_last('_trail', '_sorted', size)} end"
    return b.with_columns({out: text}).drop_scratch().core()


def cumulative(bars: DataFrame, outputs: dict[str, Column], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Running sums over whole series, two-level."""
    return running(bars, F.floor(F.col(POS) / BLOCK_ROWS), [POS], sums=outputs, keys=keys)


def on_balance_volume(bars: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Running sum of volume signed by the close-to-close move."""
    b = in_blocks(bars, back=1, keys=keys)
    b = b.with_columns({"_pc": b.lag("close", 1)}).with_columns({"signed_volume": ind.signed_volume()})
    return cumulative(b.drop_scratch().core(), {"obv": F.col("signed_volume")}, keys)


def fill_forward(
    bars: DataFrame, columns: Iterable[str], default: float | None = None, keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """Take the last earlier value where one is missing, then the default."""
    columns = list(columns)
    filled = forward_fill(bars, columns, F.floor(F.col(POS) / BLOCK_ROWS), [POS], keys)
    return filled if default is None else filled.fillna(default, columns)


def crossings(bars: DataFrame, a: str, b: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """`crossed_above` / `crossed_below`: a passed b on this bar, having been on the other side (or equal) before."""
    blocks = in_blocks(bars, back=1, keys=keys)
    blocks = blocks.with_columns({"_a": blocks.lag(a, 1), "_b": blocks.lag(b, 1)})
    return (
        blocks.with_columns(
            {
                "crossed_above": flag(crossed_above(a, b, "_a", "_b")),
                "crossed_below": flag(crossed_below(a, b, "_a", "_b")),
            }
        )
        .drop_scratch()
        .core()
    )


def basic_indicators(bars: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """True range, ATR and its percentage, RSI, ADX with both DI, MACD, Bollinger bands and VWAP, defaults as usual."""
    alphas = [ind.span(n) for n in (9, 12, 26)] + [ind.wilder(14)]
    b = in_blocks(bars, back=ind.reach(ind.wilder(14), ind.wilder(14)) + ind.reach(ind.span(26)), alphas=alphas, keys=keys)
    b = b.with_columns(
        {
            **ind.previous_bar(b),
            "bb_mid": b.roll("avg", "close", 20, skip=0),
            "_std": b.roll("stddev_samp", "close", 20, skip=0),
            "_pv": b.roll("sum", "(high + low + close) / 3 * volume", 20, skip=0),
            "_vol": b.roll("sum", "volume", 20, skip=0),
        }
    ).with_columns(ind.moves())
    b = b.ewm({"_atr": ind.atr_request(), **ind.rsi_requests(14), **ind.dmi_requests(), **ind.ema_requests(12, 26)})
    b = b.with_columns(ind.dmi())
    b = b.ewm({"adx": ind.adx_request(), "macd_signal": ind.macd_signal_request()})
    upper, lower = ind.bollinger("bb_mid", "_std")
    return (
        b.with_columns(
            {
                "true_range": "_tr",
                "atr": "_atr",
                "atr_pct": f"coalesce({div('_atr', 'close')} * 100, 0D)",
                "rsi": ind.rsi(14),
                "plus_di": "_dmp",
                "minus_di": "_dmn",
                "macd": ind.MACD_LINE,
                "macd_hist": f"{ind.MACD_LINE} - macd_signal",
                "bb_upper": upper,
                "bb_lower": lower,
                "vwap": sdiv("_pv", "_vol"),
            }
        )
        .drop_scratch()
        .core()
    )
