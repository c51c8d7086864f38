"""Indicators built on the rolling and exponentially weighted primitives, as SQL text over numbered bars.

Column names that start with an underscore are intermediate.
"""

from __future__ import annotations

import math

from barloom.functions.text import ln, ratio, sdiv
from barloom.plans.blocks import Blocked, Ewm, memory_rows

MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
MACD_LINE = f"(_ema{MACD_FAST} - _ema{MACD_SLOW})"
PREVIOUS = {"_pc": "close", "_ph": "high", "_pl": "low"}


def span(n: int) -> float:
    return 2.0 / (n + 1.0)


def wilder(n: int) -> float:
    return 1.0 / n


def reach(*alphas: float) -> int:
    """Rows a chain of smoothings looks back."""
    return sum(memory_rows(a) for a in alphas)


def previous_bar(b: Blocked) -> dict[str, str]:
    return {name: b.lag(x, 1) for name, x in PREVIOUS.items()}


def moves() -> dict[str, str]:
    """True range, gain and loss, directional moves and returns, from the previous bar."""
    up, down = "(high - _ph)", "(_pl - low)"
    return {
        "_tr": "greatest(high - low, abs(high - _pc), abs(low - _pc))",
        "_gain": "case when close < _pc then 0D else close - _pc end",
        "_loss": "case when close > _pc then 0D else _pc - close end",
        "_pdm": f"case when {up} > {down} and {up} > 0 then {up} else 0D end",
        "_ndm": f"case when {down} > {up} and {down} > 0 then {down} else 0D end",
        "_lr1": ln(ratio("close", "_pc")),
        "_ret": f"{ratio('close', '_pc')} - 1",
    }


def atr_request(n: int = 14) -> Ewm:
    return Ewm("_tr", wilder(n), n)


def rsi_requests(*lengths: int) -> dict[str, Ewm]:
    out = {}
    for n in lengths:
        out[f"_gain{n}"] = Ewm("_gain", wilder(n), n, skip=1)
        out[f"_loss{n}"] = Ewm("_loss", wilder(n), n, skip=1)
    return out


def rsi(n: int) -> str:
    return f"(100 - try_divide(100D, 1 + {sdiv(f'_gain{n}', f'_loss{n}')}))"


def ema_requests(*periods: int) -> dict[str, Ewm]:
    return {f"_ema{n}": Ewm("close", span(n), n) for n in periods}


def dmi_requests(n: int = 14) -> dict[str, Ewm]:
    return {"_pdmn": Ewm("_pdm", wilder(n), n), "_ndmn": Ewm("_ndm", wilder(n), n)}


def dmi() -> dict[str, str]:
    """+DI and -DI from the smoothed moves."""
    return {"_dmp": f"100 * {sdiv('_pdmn', '_atr')}", "_dmn": f"100 * {sdiv('_ndmn', '_atr')}"}


def adx_request(n: int = 14) -> Ewm:
    """Smoothing of the directional index of `_dmp` and `_dmn`."""
    return Ewm(f"100 * {sdiv('abs(_dmp - _dmn)', '_dmp + _dmn')}", wilder(n), n, skip=n - 1)


def macd_signal_request() -> Ewm:
    return Ewm(MACD_LINE, span(MACD_SIGNAL), MACD_SIGNAL, skip=MACD_SLOW - 1)


def bollinger(mid: str, std: str) -> tuple[str, str]:
    """Upper and lower band at two sample standard deviations."""
    return f"({mid} + 2 * {std})", f"({mid} - 2 * {std})"


def weighted_mean(values: list[str]) -> str:
    """Linearly weighted mean; `values[0]` is the newest and weighs most. NULL if any value is."""
    n = len(values)
    total = " + ".join(f"{n - k}D * {x}" for k, x in enumerate(values))
    return f"({total}) / {n * (n + 1) // 2}D"


def hull_parts(n: int) -> tuple[int, int, int]:
    """Half, full and smoothing length of a Hull average."""
    return max(n // 2, 1), n, max(math.isqrt(n), 1)


def percent_rank_of_last(values: str, ordered: str, size: int) -> str:
    """Average-rank percentile of the last of `size` values; `ordered` holds the same values sorted."""
    last = f"get({values}, size({values}) - 1)"
    below = f"(array_position({ordered}, {last}) - 1)"
    above = f"(array_position(reverse({ordered}), {last}) - 1)"
    return f"({below} + ({size + 1} - {below} - {above}) / 2D) / {size}D"


def signed_volume() -> str:
    """Volume with the sign of the close-to-close move, 0 on the first bar."""
    return "coalesce(signum(close - _pc), 0D) * volume"
