"""From predictions to non-overlapping trades and a compounded account, per symbol and scenario."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import KEYS, TradeParams
from barloom.plans.blocks import POS, in_blocks
from barloom.plans.scan import running
from barloom.plans.settle import settle

CHUNK = 256
TILE = 1 << 16


def _scenario_column(scenarios: Sequence[TradeParams]) -> Column:
    """Array of scenario settings, exploded next to each bar: a sweep needs no join."""
    return F.array(
        *[
            F.struct(
                F.lit(s.name).alias("scenario"),
                F.lit(float(s.confidence)).alias("_min_conf"),
                F.lit(float(s.min_move)).alias("_min_move"),
                F.lit(float(s.tp_fraction)).alias("_tp_fraction"),
                F.lit(float(s.sl_fraction)).alias("_sl_fraction"),
                F.lit(float(s.round_trip_cost)).alias("_cost"),
                F.lit(float(s.position_fraction)).alias("_fraction"),
                F.lit(float(s.initial_capital)).alias("_capital"),
                F.lit(float(s.ruin_equity)).alias("_ruin"),
                F.lit(int(s.max_hold)).alias("_hold"),
            )
            for s in scenarios
        ]
    )


def candidate_trades(
    predictions: DataFrame, scenarios: Sequence[TradeParams] = (TradeParams(),), keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """Every signal with the outcome it would have if taken: one row per symbol, scenario and signal bar.

    `predictions` are numbered bars with `p_up`, `up_pred`, `dn_pred`, `y_up`, `y_dn`; bars without a
    prediction have NULL there. Entry is the open of the next bar, which already counts for the barriers.
    """
    longest = max(s.max_hold for s in scenarios)
    b = in_blocks(predictions, ahead=longest, keys=keys)
    ahead = b.window(f"rows between 1 following and {longest} following")
    b = b.with_columns({"_path": f"collect_list(struct(high as h, low as l, close as c, open as o, ts)) {ahead}"})
    rows = b.core().where("p_up is not null and size(_path) > 0")
    rows = rows.selectExpr("*", "greatest(p_up, 1 - p_up) as confidence", "p_up >= 0.5 as _long").selectExpr(
        "*", "if(_long, up_pred, dn_pred) as pred_move", "if(_long, 1D, -1D) as _sign"
    )
    # a bar is copied only for the scenarios whose thresholds it passes
    passed = F.filter(
        _scenario_column(scenarios),
        lambda s: (F.col("confidence") >= s["_min_conf"]) & (F.col("pred_move") >= s["_min_move"]),
    )
    rows = rows.select("*", F.inline(passed))
    rows = rows.selectExpr("*", "slice(_path, 1, _hold) as _held", "_path[0].o as _entry").drop("_path")
    rows = rows.selectExpr(
        "*",
        "_entry * (1 + _sign * (pred_move * _tp_fraction / 100)) as _tp",
        "_entry * (1 - _sign * (pred_move * _sl_fraction / 100)) as _sl",
    )
    rows = rows.selectExpr(
        "*",
        "nullif(array_position(transform(_held, x -> if(_long, x.h >= _tp, x.l <= _tp)), true), 0) as _tp_step",
        "nullif(array_position(transform(_held, x -> if(_long, x.l <= _sl, x.h >= _sl)), true), 0) as _sl_step",
    )
    rows = rows.selectExpr(
        "*",
        "case when _sl_step <= coalesce(_tp_step, _sl_step) then 'SL' when _tp_step is not null then 'TP' "
        "else 'TIME' end as exit_reason",
    )
    rows = rows.selectExpr(
        "*",
        "int(case exit_reason when 'SL' then _sl_step when 'TP' then _tp_step else size(_held) end) as hold_bars",
        "case exit_reason when 'SL' then _sl when 'TP' then _tp else element_at(_held, -1).c end as _exit",
    )
    return rows.selectExpr(
        *keys,
        "scenario",
        POS,
        f"{POS} + hold_bars as exit_rn",
        "_held[0].ts as entry_time",
        "_held[hold_bars - 1].ts as exit_time",
        "if(_long, 'LONG', 'SHORT') as side",
        "confidence",
        "pred_move",
        "double(if(_long, y_up, y_dn)) as achieved",
        "_long = (y_up >= y_dn) as dir_correct",
        "exit_reason",
        "hold_bars",
        "(_exit - _entry) / _entry * _sign as _raw",
        "(_exit - _entry) / _entry * _sign - _cost as _net",
        "_fraction",
        "_capital",
        "_ruin",
    )


def non_overlapping(
    candidates: DataFrame, max_hold: int, keys: Iterable[str], start: str = POS, end: str = "exit_rn"
) -> DataFrame:
    """Earliest-first selection: take a candidate, skip those that start by its end bar, repeat.

    A candidate lasts at most `max_hold` bars, so all a stretch of bars needs to know about the past is the
    first free bar, at most max_hold bars into it. Each chunk of bars therefore is a table from max_hold + 1
    entry states to exit states. The tables are built per chunk in parallel, composed per group of chunks
    and per series, and the entry states found that way select the trades inside each chunk, again in
    parallel. No task sees more than one chunk, one group of chunk tables, or one table per group.
    """
    keys = list(keys)
    size = CHUNK
    while size <= max_hold:
        size *= 2
    group = size * CHUNK
    rest = [c for c in candidates.columns if c not in (*keys, start, end)]
    item = F.struct(F.col(start), F.col(end), *rest)
    chunks = candidates.groupBy(*keys, F.floor(F.col(start) / size).alias("_chunk")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(start), item.alias("row")))).alias("_items")
    )
    chunks = settle(chunks)

    def states(first_bar: str) -> str:
        return f"transform(sequence(0, {max_hold}), s -> {first_bar} + s)"

    def relative(acc: str, next_bar: str) -> str:
        return f"transform({acc}, f -> int(greatest(f - {next_bar}, 0)))"

    take = f"(acc, x) -> transform(acc, f -> if(x.{start} >= f, x.row.{end} + 1, f))"
    tables = chunks.select(
        *keys,
        "_chunk",
        F.floor(F.col("_chunk") / CHUNK).alias("_group"),
        F.expr(
            relative(f"aggregate(_items, {states(f'_chunk * {size}')}, {take})", f"(_chunk + 1) * {size}")
        ).alias("_table"),
    )
    groups = tables.groupBy(*keys, "_group").agg(
        F.sort_array(F.collect_list(F.struct("_chunk", "_table"))).alias("_tables")
    )

    def through(bar: str, unit: int, index: str) -> str:
        return f"(x.{index} + 1) * {unit} + x._table[int(greatest({bar} - x.{index} * {unit}, 0))]"

    step = f"(acc, x) -> transform(acc, f -> {through('f', size, '_chunk')})"
    group_tables = groups.select(
        *keys,
        "_group",
        "_tables",
        F.expr(
            relative(f"aggregate(_tables, {states(f'_group * {group}')}, {step})", f"(_group + 1) * {group}")
        ).alias("_table"),
    )
    series = group_tables.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_group", "_table"))).alias("_groups")
    )

    def entries(array: str, first: str, unit: int, index: str) -> str:
        """Entry bar of every element, by one pass that carries the first free bar."""
        return (
            f"aggregate({array}, named_struct('f', {first}, 'out', array()), (acc, x) -> named_struct("
            f"'f', {through('acc.f', unit, index)}, 'out', concat(acc.out, array(acc.f))), acc -> acc.out)"
        ).replace("array())", "cast(array() as array<bigint>))", 1)

    by_group = series.select(
        *keys,
        F.expr(f"inline(arrays_zip(_groups._group, {entries('_groups', 'bigint(0)', group, '_group')}))").alias(
            "_group", "_free"
        ),
    )
    by_chunk = groups.join(by_group, [*keys, "_group"]).select(
        *keys,
        F.expr(f"inline(arrays_zip(_tables._chunk, {entries('_tables', '_free', size, '_chunk')}))").alias(
            "_chunk", "_free"
        ),
    )
    picked = (
        "aggregate(_items, named_struct('f', _free, 'out', cast(array() as array<bigint>)), (acc, x) -> "
        f"if(x.{start} >= acc.f, named_struct('f', x.row.{end} + 1, 'out', concat(acc.out, array(x.{start}))), acc), "
        "acc -> acc.out)"
    )
    taken = chunks.join(by_chunk, [*keys, "_chunk"]).select(*keys, "_items", F.expr(picked).alias("_picked"))
    return taken.select(
        *keys, F.expr(f"inline(transform(filter(_items, x -> array_contains(_picked, x.{start})), x -> x.row))")
    )


def with_equity(trades: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Compounded account after each trade; trades after the account fell to the ruin level are dropped.

    Growth is a two-level running sum of logs, so one long account is spread over tasks.
    """
    keys = list(keys)
    factor = 1.0 + F.col("_fraction") * F.col("_net")
    log = F.when(factor > 0.0, F.ln(factor)).otherwise(F.lit(-700.0))
    tile = F.floor(F.col(POS) / TILE)
    grown = running(trades, tile, [POS], sums={"_log": log}, keys=keys)
    before = F.col("_capital") * F.exp(F.col("_log") - log)
    grown = grown.withColumns({"pnl_usd": before * F.col("_fraction") * F.col("_net"), "equity": before * factor})
    ruin = grown.groupBy(*keys).agg(F.min(F.when(F.col("equity") <= F.col("_ruin"), F.col(POS))).alias("_ruined"))
    kept = grown.join(ruin, keys).where(F.col("_ruined").isNull() | (F.col(POS) <= F.col("_ruined")))
    return kept.drop("_log", "_ruined")


def backtest(
    predictions: DataFrame, scenarios: Sequence[TradeParams] = (TradeParams(),), keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """Trade ledger of every symbol and scenario."""
    by = [*keys, "scenario"]
    candidates = candidate_trades(predictions, scenarios, keys)
    taken = settle(non_overlapping(candidates, max(s.max_hold for s in scenarios), by))
    return with_equity(taken, by).withColumns(
        {"raw_ret_pct": F.col("_raw") * 100.0, "net_ret_pct": F.col("_net") * 100.0}
    )


LEDGER = (
    "entry_time",
    "exit_time",
    "side",
    "confidence",
    "pred_move",
    "achieved",
    "dir_correct",
    "exit_reason",
    "hold_bars",
    "raw_ret_pct",
    "net_ret_pct",
    "pnl_usd",
    "equity",
)


def ledger(trades: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return trades.select(*keys, "scenario", *LEDGER)


def accounts(
    predictions: DataFrame, scenarios: Sequence[TradeParams] = (TradeParams(),), keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """Start capital of every symbol and scenario, whether or not it ever trades."""
    every = predictions.select(*keys).distinct().select(*keys, F.inline(_scenario_column(scenarios)))
    return every.select(*keys, "scenario", "_capital")


def equity_curve(
    trades: DataFrame, keys: Iterable[str] = (*KEYS, "scenario"), opened: DataFrame | None = None
) -> DataFrame:
    """Account by trade number with peak and drawdown; number 0 is the start capital.

    `opened` lists all accounts (see `accounts`), so that those without trades keep their first row; without it
    the accounts are those that traded.
    """
    keys = list(keys)
    tile = F.floor(F.col(POS) / TILE)
    counted = running(
        trades.select(*keys, POS, "equity", "_capital"), tile, [POS], sums={"trade_no": F.lit(1)},
        maxima={"_peak": F.col("equity")}, keys=keys,
    )
    opened = trades if opened is None else opened
    start = opened.groupBy(*keys).agg(F.max("_capital").alias("equity")).withColumns(
        {"trade_no": F.lit(0).cast("long"), "peak": F.col("equity"), "drawdown": F.lit(0.0)}
    )
    peak = F.greatest("_peak", "_capital")
    rows = counted.select(
        *keys, "equity", "trade_no", peak.alias("peak"), ((F.col("equity") - peak) / peak).alias("drawdown")
    )
    return rows.unionByName(start.select(*rows.columns))
