"""Coarser bars and their features brought back to the base bars without looking ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import KEYS
from barloom.functions.names import CONTEXT_FEATURES
from barloom.functions.scalar import from_local_seconds, local_seconds
from barloom.functions.text import sdiv
from barloom.operators import indicators as ind
from barloom.plans.blocks import Blocked, as_one_block, in_blocks

# Widths of the two context timeframes in seconds, widest last; each must divide the next.
CONTEXTS = {"mtf_4h_": 4 * 3600, "mtf_1d_": 86400}

BACK = max(ind.reach(ind.span(50)), ind.reach(ind.wilder(14), ind.wilder(14)), ind.reach(ind.wilder(21))) + 3


def bin_label(ts: Column, seconds: int) -> Column:
    """Right edge of the right-closed bin, counted from local midnight, in local seconds."""
    return F.ceil(local_seconds(ts) / seconds) * seconds


def resample(bars: DataFrame, seconds: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Bars of `seconds` width, right-closed and labelled by their right edge; empty bins do not appear."""
    return (
        bars.groupBy(*keys, bin_label(F.col("ts"), seconds).alias("_bin"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select(*keys, from_local_seconds(F.col("_bin")).alias("ts"), "open", "high", "low", "close", "volume")
    )


def add_context_features(b: Blocked) -> Blocked:
    """The 13 context features of the bars in `b`."""
    b = b.with_columns(
        {
            **ind.previous_bar(b),
            "_mid": b.roll("avg", "close", 20, skip=0),
            "_std": b.roll("stddev_samp", "close", 20, skip=0),
            "_v20": b.roll("avg", "volume", 20, skip=0),
            "_vs20": b.roll("stddev_samp", "volume", 20, skip=0),
        }
    ).with_columns(ind.moves())
    b = b.recursive(
        {
            "_atr": ind.atr_request(),
            **ind.ema_requests(9, 21, 50),
            **ind.dmi_requests(),
            **ind.rsi_requests(7, 14, 21),
        }
    )
    b = b.with_columns(ind.dmi()).recursive({"adx": ind.adx_request()})
    upper, lower = ind.bollinger("_mid", "_std")
    return b.with_columns(
        {
            "log_return_1": "_lr1",
            "natr": f"{sdiv('_atr', 'close')} * 100",
            **{f"dist_ema_{n}": sdiv(f"close - _ema{n}", f"_ema{n}") for n in (9, 21, 50)},
            "ema_9_21_spread": sdiv("_ema9 - _ema21", "_ema21"),
            "ema_21_50_spread": sdiv("_ema21 - _ema50", "_ema50"),
            "trend_regime": "signum(close - _ema21)",
            "rsi_14": ind.rsi(14),
            "rsi_slope_7_21": sdiv(f"{ind.rsi(7)} - {ind.rsi(21)}", "100"),
            "bb_position": sdiv(f"close - {lower}", f"{upper} - {lower}"),
            "volume_surprise": sdiv("volume - _v20", "_vs20"),
        }
    )


def context_features(bars: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Numbered bars -> their context features."""
    b = add_context_features(in_blocks(bars, back=BACK, keys=keys))
    return b.core().select(*keys, "ts", *CONTEXT_FEATURES)


def _closed_context(coarse: DataFrame, prefix: str, seconds: int, keys: tuple[str, ...]) -> DataFrame:
    """Per coarse bar, the features of the bar before it and of the one before that."""
    b = add_context_features(as_one_block(coarse, keys=keys))
    both = f"struct({', '.join(CONTEXT_FEATURES)})"
    b = b.with_columns({f"{prefix}1": b.lag(both, 1), f"{prefix}2": b.lag(both, 2)})
    return b.core().select(*keys, local_seconds(F.col("ts")).alias(f"_bin{seconds}"), f"{prefix}1", f"{prefix}2")


def with_context(bars: DataFrame, contexts: dict[str, int] | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Add the features of the last finished coarse bar, for every context timeframe.

    A backward as-of lookup of lagged coarse features becomes one equi-join: a base bar always lies in a
    coarse bin that exists, so the bar it may see is the one before its bin when it sits on the right edge
    and the one before that otherwise. Wider contexts are joined to narrower ones first, so the base table
    is joined once.
    """
    contexts = dict(CONTEXTS if contexts is None else contexts)
    return join_context(bars, context_table(resample(bars, narrowest(contexts), keys), contexts, keys), contexts, keys)


def narrowest(contexts: dict[str, int] | None = None) -> int:
    """Width of the narrowest context."""
    widths = list((CONTEXTS if contexts is None else contexts).values())
    if any(b % a for a, b in zip(widths, widths[1:])):
        raise ValueError("context widths must be given narrow to wide, each dividing the next")
    if widths[0] < 3600:
        raise ValueError("context bars are an hour or wider: each series of them is kept in one block")
    return widths[0]


def context_table(
    coarse: DataFrame, contexts: dict[str, int] | None = None, keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """Features of the finished bars of all contexts, per bin of the narrowest, from the narrowest bars."""
    contexts = dict(CONTEXTS if contexts is None else contexts)
    widths = list(contexts.values())
    table, narrow = None, narrowest(contexts)
    for prefix, seconds in contexts.items():
        if seconds != narrow:
            coarse = resample(coarse, seconds, keys)
        closed = _closed_context(coarse, prefix, seconds, keys)
        if table is None:
            table = closed
        else:
            edge = F.ceil(F.col(f"_bin{narrow}") / seconds) * seconds
            table = table.withColumn(f"_bin{seconds}", edge).join(closed, [*keys, f"_bin{seconds}"])
    return table.drop(*[f"_bin{s}" for s in widths[1:]])


def join_context(
    bars: DataFrame, table: DataFrame, contexts: dict[str, int] | None = None, keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """Look up what each bar may see in a `context_table`."""
    contexts = dict(CONTEXTS if contexts is None else contexts)
    narrow = narrowest(contexts)
    joined = bars.withColumn(f"_bin{narrow}", bin_label(F.col("ts"), narrow)).join(table, [*keys, f"_bin{narrow}"])
    joined = joined.withColumn("_now", local_seconds(F.col("ts")))
    picked = [
        f"if(_now % {seconds} = 0, {prefix}1.{name}, {prefix}2.{name}) as {prefix}{name}"
        for prefix, seconds in contexts.items()
        for name in CONTEXT_FEATURES
    ]
    scratch = [f"{prefix}{k}" for prefix in contexts for k in (1, 2)]
    return joined.selectExpr("*", *picked).drop(f"_bin{narrow}", "_now", *scratch)
