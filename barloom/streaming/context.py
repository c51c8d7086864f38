"""Context of coarser bars for a stream, kept up to date bin by bin."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.functions.names import CONTEXT_FEATURES
from barloom.operators import indicators as ind
from barloom.operators.resample import CONTEXTS, narrowest
from barloom.streaming.indicators import MICROS, smoothed_on, wall_micros

BAR = ["at", "open", "high", "low", "close", "volume"]
OPEN_SCHEMA = "at long, open double, high double, low double, close double, volume double"
#: State after a bin: bars so far, its label, the numbers of `NUMBERS`, the last closes and volumes, and the features
#: of the last bin and of the one before.
BIN_SCHEMA = "seen long, at long, numbers array<double>, closes array<double>, volumes array<double>, last array<double>, before array<double>"
EMAS, RSIS, LENGTH, BAND = (9, 21, 50), (7, 14, 21), 14, 20
NUMBERS = ("high", "low", *(f"ema{n}" for n in EMAS), "atr", "pdm", "ndm", "adx", *(f"{x}{n}" for n in RSIS for x in ("gain", "loss")))
NONE = [float("nan")] * len(CONTEXT_FEATURES)


@dataclass(frozen=True)
class Bin:
    """What the finished bins of one width leave behind."""

    seen: int = 0
    at: int = -(1 << 62)
    numbers: list[float] = field(default_factory=lambda: [float("nan")] * len(NUMBERS))
    closes: list[float] = field(default_factory=list)
    volumes: list[float] = field(default_factory=list)
    last: list[float] = field(default_factory=lambda: NONE)
    before: list[float] = field(default_factory=lambda: NONE)

    def row(self) -> tuple:
        return self.seen, self.at, self.numbers, self.closes, self.volumes, self.last, self.before


def coarse(bars: pd.DataFrame, seconds: int) -> pd.DataFrame:
    """Right-closed bins of bars in time order, labelled by their right edge."""
    width = seconds * MICROS
    label = -(-bars["at"] // width) * width
    return bars.groupby(label).agg(open=("open", "first"), high=("high", "max"), low=("low", "min"), close=("close", "last"), volume=("volume", "sum"))


def _sdiv(a, b):
    with np.errstate(divide="ignore", invalid="ignore"):
        return a / (b + 1e-9)


def _trailing(before: list[float], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of the last `BAND` values, NaN until there are as many."""
    whole = np.concatenate([np.full(BAND - 1 - len(before), np.nan), before, values])
    frames = np.lib.stride_tricks.sliding_window_view(whole, BAND)
    return frames.mean(axis=1), frames.std(axis=1, ddof=1)


def followed(state: Bin, bins: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features (a row per bin, in the order of `CONTEXT_FEATURES`) and numbers after each of the bins that follow."""
    known = dict(zip(NUMBERS, state.numbers, strict=True))
    high, low, close, volume = (bins[c].to_numpy(float) for c in ("high", "low", "close", "volume"))
    seen = state.seen + np.arange(1, len(bins) + 1)
    shown = lambda x, need: np.where(seen >= need, x, np.nan)
    earlier = lambda first, x: np.concatenate([[first], x[:-1]])
    pc, ph, pl = earlier(state.closes[-1] if state.closes else np.nan, close), earlier(known["high"], high), earlier(known["low"], low)
    move, up, down = close - pc, high - ph, pl - low
    new = {"high": high, "low": low}
    for n in EMAS:
        new[f"ema{n}"] = smoothed_on(known[f"ema{n}"], close, ind.span(n))
    w = ind.wilder(LENGTH)
    new["atr"] = smoothed_on(known["atr"], np.fmax(high - low, np.fmax(np.abs(high - pc), np.abs(low - pc))), w)
    with np.errstate(invalid="ignore"):
        new["pdm"] = smoothed_on(known["pdm"], np.where((up > down) & (up > 0), up, 0.0), w)
        new["ndm"] = smoothed_on(known["ndm"], np.where((down > up) & (down > 0), down, 0.0), w)
    plus, minus = 100.0 * _sdiv(new["pdm"], new["atr"]), 100.0 * _sdiv(new["ndm"], new["atr"])
    new["adx"] = smoothed_on(known["adx"], shown(100.0 * _sdiv(np.abs(plus - minus), plus + minus), LENGTH), w)
    rsi = {}
    for n in RSIS:
        for x, moves in (("gain", np.where(move < 0, 0.0, move)), ("loss", np.where(move > 0, 0.0, -move))):
            new[f"{x}{n}"] = smoothed_on(known[f"{x}{n}"], moves, ind.wilder(n))
        rsi[n] = shown(100.0 - 100.0 / (1.0 + _sdiv(new[f"gain{n}"], new[f"loss{n}"])), n + 1)
    ema = {n: shown(new[f"ema{n}"], n) for n in EMAS}
    mid, deviation = _trailing(state.closes, close)
    usual, spread = _trailing(state.volumes, volume)
    with np.errstate(divide="ignore", invalid="ignore"):
        made = {
            "log_return_1": np.log(close / pc),
            "natr": _sdiv(shown(new["atr"], LENGTH), close) * 100,
            **{f"dist_ema_{n}": _sdiv(close - ema[n], ema[n]) for n in EMAS},
            "ema_9_21_spread": _sdiv(ema[9] - ema[21], ema[21]),
            "ema_21_50_spread": _sdiv(ema[21] - ema[50], ema[50]),
            "trend_regime": np.sign(close - ema[21]),
            "rsi_14": rsi[14],
            "rsi_slope_7_21": _sdiv(rsi[7] - rsi[21], 100.0),
            "adx": shown(new["adx"], 2 * LENGTH - 1),
            "bb_position": _sdiv(close - (mid - 2 * deviation), (mid + 2 * deviation) - (mid - 2 * deviation)),
            "volume_surprise": _sdiv(volume - usual, spread),
        }
    return np.column_stack([made[c] for c in CONTEXT_FEATURES]), np.column_stack([new[c] for c in NUMBERS])


def closed_up_to(state: Bin, bins: pd.DataFrame, features: np.ndarray, numbers: np.ndarray, label: int) -> Bin:
    """The state after the bins up to the label."""
    k = int((bins.index <= label).sum())
    if not k:
        return state
    rows = [state.before, state.last, *features[:k].tolist()]
    kept = lambda before, values: [*before, *values[:k].tolist()][-(BAND - 1) :]
    closes, volumes = kept(state.closes, bins["close"].to_numpy(float)), kept(state.volumes, bins["volume"].to_numpy(float))
    return Bin(state.seen + k, int(bins.index[k - 1]), numbers[k - 1].tolist(), closes, volumes, rows[-1], rows[-2])


class LiveContext(StatefulProcessor):
    """Per symbol: the state after the finished bins of every width, and the bars of the bins that are open."""

    def __init__(self, contexts: dict[str, int], lateness: int) -> None:
        self.contexts, self.lateness = contexts, lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bins = {prefix: handle.getValueState(f"{prefix}bin", BIN_SCHEMA) for prefix in self.contexts}
        self.open = handle.getListState("open", OPEN_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        states = {}
        for prefix, value in self.bins.items():
            states[prefix] = Bin(*(list(x) if i > 1 else int(x) for i, x in enumerate(value.get()))) if value.exists() else Bin()
        kept = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        open_ = pd.DataFrame(kept, columns=BAR).astype({"at": "int64"})
        new = pd.concat([chunk[BAR] for chunk in rows]).drop_duplicates("at")
        narrow = min(self.contexts, key=self.contexts.get)
        new = new[~new["at"].isin(open_["at"]) & (new["at"] > states[narrow].at)]
        if new.empty:
            return
        bars = pd.concat([open_, new]) if len(open_) else new
        bars = bars.sort_values("at", ignore_index=True)
        final = int(bars["at"].iloc[-1]) - self.lateness
        out = bars[bars["at"] >= new["at"].min()]
        at = out["at"].to_numpy()
        shown = {"symbol": key[0], "ts": pd.to_datetime(at, unit="us"), **{c: out[c].to_numpy() for c in BAR[1:]}}
        oldest = None
        for prefix, seconds in self.contexts.items():
            width, state = seconds * MICROS, states[prefix]
            bins = coarse(bars[bars["at"] > state.at], seconds)
            features, numbers = followed(state, bins)
            table = np.vstack([state.before, state.last, features])
            place = np.searchsorted(bins.index.to_numpy(), at)  # the first bin whose label is not before the bar
            picked = table[place + (at % width == 0)]
            shown |= {f"{prefix}{c}": picked[:, i] for i, c in enumerate(CONTEXT_FEATURES)}
            after = closed_up_to(state, bins, features, numbers, final // width * width)
            if after is not state:
                self.bins[prefix].update(after.row())
            oldest = after.at if oldest is None else min(oldest, after.at)
        rest = [(int(a), *map(float, x)) for a, *x in bars.loc[bars["at"] > oldest, BAR].itertuples(index=False)]
        self.open.put(rest) if rest else self.open.clear()
        yield pd.DataFrame(shown)


def live_context(bars: DataFrame, contexts: dict[str, int] | None = None, lateness_seconds: float = 0) -> DataFrame:
    """Bars of a stream with the features of the last finished coarse bars, as `resample.with_context` adds them, in
    update mode.

    A bar that comes up to `lateness_seconds` after a newer one of its symbol goes into its bins, and the bars after it
    are sent again: the last update of a bar counts (`bars.latest`). Repeated bars and those that come later are left
    out. The state of a symbol is some sixty numbers a width, for smoothings that forget nothing, and the bars of the
    open bins; a batch costs its own rows and those, whatever came before.
    """
    contexts = dict(CONTEXTS if contexts is None else contexts)
    narrowest(contexts)  # widths that nest
    columns = ["open", "high", "low", "close", "volume"]
    context = ", ".join(f"{prefix}{c} double" for prefix in contexts for c in CONTEXT_FEATURES)
    schema = f"symbol string, ts timestamp_ntz, {', '.join(f'{c} double' for c in columns)}, {context}"
    rows = bars.select("symbol", wall_micros(), *columns).groupBy("symbol")
    return rows.transformWithStateInPandas(LiveContext(contexts, int(lateness_seconds * MICROS)), schema, "Update", "none")
