"""EMA, ATR and RSI of a stream of bars that may come late, repeated or out of order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.operators import indicators as ind
from barloom.plans.blocks import POS, TOTAL, Ewm, in_blocks

ROWS_SCHEMA = "symbol string, ts timestamp_ntz, close double, ema double, atr double, rsi double"
KNOWN_SCHEMA = "seen long, at long, close double, ema double, atr double, gain double, loss double"
OPEN_SCHEMA = "at long, high double, low double, close double"
MICROS = 1_000_000


@dataclass(frozen=True)
class Lengths:
    """Span of the EMA and length of ATR and RSI."""

    ema: int = 21
    wilder: int = 14


@dataclass(frozen=True)
class Known:
    """What all bars up to the time `at` leave behind; gain and loss are missing after the first bar."""

    seen: int
    at: int
    close: float
    ema: float
    atr: float
    gain: float
    loss: float


def smoothed_on(before: float, values: np.ndarray, alpha: float) -> np.ndarray:
    """Means after each value, from the mean before them (missing: the first value starts it)."""
    return pd.Series(np.concatenate([[before], values])).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]


def advanced(known: Known | None, bars: pd.DataFrame, lengths: Lengths) -> pd.DataFrame:
    """State after each of `bars` (at, high, low, close; by time), which follow the known ones."""
    high, low, close = (bars[c].to_numpy(float) for c in ("high", "low", "close"))
    last = np.concatenate([[known.close if known else np.nan], close[:-1]])
    move = close - last
    true_range = np.fmax(high - low, np.fmax(np.abs(high - last), np.abs(low - last)))
    up, down = np.where(move < 0, 0.0, move), np.where(move > 0, 0.0, -move)
    start = known or Known(0, 0, np.nan, np.nan, np.nan, np.nan, np.nan)
    w = ind.wilder(lengths.wilder)
    return pd.DataFrame(
        {
            "seen": start.seen + np.arange(1, len(bars) + 1),
            "at": bars["at"].to_numpy(),
            "close": close,
            "ema": smoothed_on(start.ema, close, ind.span(lengths.ema)),
            "atr": smoothed_on(start.atr, true_range, w),
            "gain": smoothed_on(start.gain, up, w),
            "loss": smoothed_on(start.loss, down, w),
        }
    )


def _shown(symbol: str, states: pd.DataFrame, lengths: Lengths) -> pd.DataFrame:
    """Rows of the result: values appear once enough bars were seen, as in the batch operators."""
    seen = states["seen"]
    rsi = 100.0 - 100.0 / (1.0 + states["gain"] / (states["loss"] + 1e-9))
    return pd.DataFrame(
        {
            "symbol": symbol,
            "ts": pd.to_datetime(states["at"], unit="us"),
            "close": states["close"],
            "ema": states["ema"].where(seen >= lengths.ema),
            "atr": states["atr"].where(seen >= lengths.wilder),
            "rsi": rsi.where(seen > lengths.wilder),
        }
    )


class RunningIndicators(StatefulProcessor):
    """Per symbol: the state after the closed bars, and the bars that later ones may still go in between."""

    def __init__(self, lengths: Lengths, lateness: int) -> None:
        self.lengths, self.lateness = lengths, lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", KNOWN_SCHEMA)
        self.open = handle.getListState("open", OPEN_SCHEMA)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        self.known.update((int(row["seen"]), int(row["at"]), *(float(row[c]) for c in ("close", "ema", "atr", "gain", "loss"))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = Known(*self.known.get()) if self.known.exists() else None
        kept = [(int(a), *x) for a, *x in self.open.get()] if self.open.exists() else []
        open_ = pd.DataFrame(kept, columns=["at", "high", "low", "close"])
        new = pd.concat([chunk[["at", "high", "low", "close"]] for chunk in rows]).drop_duplicates("at")
        new = new[~new["at"].isin(open_["at"])]
        if known is not None:
            new = new[new["at"] > known.at]
        if new.empty:
            return
        bars = pd.concat([open_, new]) if len(open_) else new
        bars = bars.sort_values("at", ignore_index=True)
        states = advanced(known, bars, self.lengths)
        closed = int((bars["at"] <= bars["at"].iloc[-1] - self.lateness).sum())
        if closed:
            row = states.iloc[closed - 1]
            self.known.update(astuple(Known(int(row["seen"]), int(row["at"]), *(float(row[c]) for c in ("close", "ema", "atr", "gain", "loss")))))
        rest = [(int(a), float(h), float(l), float(c)) for a, h, l, c in bars.iloc[closed:].itertuples(index=False)]
        self.open.put(rest) if rest else self.open.clear()
        yield _shown(key[0], states[states["at"] >= new["at"].min()], self.lengths)


def state_after(bars: DataFrame, lengths: Lengths = Lengths()) -> DataFrame:
    """State of each symbol after its last numbered bar, by the batch operators: a stream that goes on from these bars
    starts with it."""
    w = ind.wilder(lengths.wilder)
    alphas = [ind.span(lengths.ema), w]
    b = in_blocks(bars, back=max(ind.reach(a) for a in alphas) + 1, alphas=alphas)
    b = b.with_columns(ind.previous_bar(b)).with_columns(ind.moves())
    b = b.ewm({"ema": Ewm("close", alphas[0], 1), "atr": Ewm("_tr", w, 1), "gain": Ewm("_gain", w, 1, skip=1), "loss": Ewm("_loss", w, 1, skip=1)})
    last = b.core().where(F.col(POS) == F.col(TOTAL) - 1)
    missing = F.lit(float("nan"))
    return last.select("symbol", F.col(TOTAL).alias("seen"), wall_micros(), "close", "ema", "atr", F.coalesce("gain", missing).alias("gain"), F.coalesce("loss", missing).alias("loss"))


def wall_micros():
    """The wall clock of `ts` in microseconds, as `at`."""
    whole = F.unix_date(F.to_date("ts")).cast("long") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60
    return (whole * MICROS + F.expr("cast(extract(second from ts) * 1000000 as bigint)")).alias("at")


def running_indicators(
    bars: DataFrame, ema_span: int = 21, length: int = 14, lateness_seconds: float = 0, start: DataFrame | None = None
) -> DataFrame:
    """EMA, ATR and RSI of every arriving bar of a stream, in update mode.

    A bar that comes up to `lateness_seconds` after a newer one of its symbol is put in its place, and the bars after
    it are sent again: the last update of a bar counts (`bars.latest`). Of repeated bars the first counts; bars that
    come later than that, or not after the bars of `start` (from `state_after`), are left out. The state of a symbol is
    seven numbers and the bars within the lateness; a batch costs its own rows and those, whatever came before.
    """
    lengths = Lengths(ema_span, length)
    processor = RunningIndicators(lengths, int(lateness_seconds * MICROS))
    rows = bars.select("symbol", wall_micros(), "high", "low", "close").groupBy("symbol")
    begin = None if start is None else start.groupBy("symbol")
    return rows.transformWithStateInPandas(processor, ROWS_SCHEMA, "Update", "none", begin)
