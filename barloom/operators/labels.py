"""First-touched-barrier outcomes, best-trade labels and their confirmation filter."""

from __future__ import annotations

from dataclasses import replace
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import KEYS, BarrierParams, ConfirmParams
from barloom.functions.names import (
    BEAR_FLAGS,
    BEAR_INVERTED,
    BULL_FLAGS,
    DIRECTION_NAMES,
    EXIT_NAMES,
    EXIT_NONE,
    EXIT_SL,
    EXIT_TIMEOUT,
    EXIT_TP,
    LONG,
    NEUTRAL,
    SHORT,
)
from barloom.functions.scalar import code_name, count_true
from barloom.functions.text import div, finite_or
from barloom.operators import indicators as ind
from barloom.operators import wide_features as wide
from barloom.operators.resample import with_context
from barloom.plans.blocks import CORE, POS, TOTAL, Blocked, Ewm, in_blocks
from barloom.plans.touch import ahead_of
from barloom.sources.bars import check_choice

MODES = ("oracle_best", "fixed_rule")
ENTRIES = ("next_open", "current_close")
SIDES = {LONG: 1, SHORT: -1}


def add_volatility(b: Blocked, params: BarrierParams) -> Blocked:
    """`atr_pct` (0 in warm-up), `atr_level` (its ratio to its 100-bar mean, 1 in warm-up) and `sma20_or_close`."""
    n = params.atr_length
    b = b.with_columns({"_pc": b.lag("close", 1), "_ma20": b.roll("avg", "close", 20, skip=0)})
    b = b.with_columns({"_tr": "greatest(high - low, abs(high - _pc), abs(low - _pc))"})
    b = b.ewm({"_watr": Ewm("_tr", ind.wilder(n), n)})
    b = b.with_columns({"atr_pct": finite_or(f"{div('_watr', 'close')} * 100", 0.0)})
    b = b.with_columns({"_atr_mean": b.roll("avg", "atr_pct", 100, skip=0)})
    b = b.with_columns(
        {"atr_level": finite_or(div("atr_pct", "_atr_mean"), 1.0), "sma20_or_close": "coalesce(_ma20, close)"}
    )
    return b.drop("_pc", "_ma20", "_tr", "_watr", "_atr_mean")


def volatility_alphas(params: BarrierParams) -> list[float]:
    return [ind.wilder(params.atr_length)]


def volatility_back(params: BarrierParams) -> int:
    return ind.reach(ind.wilder(params.atr_length)) + 102


def add_next(b: Blocked, lookahead: int) -> Blocked:
    """The next open and the close a timeout exits at: that of the last bar in the look-ahead."""
    whole = b.window("rows between unbounded preceding and unbounded following")
    return b.with_columns(
        {
            "_next_open": f"lead(open, 1) {b.window()}",
            "_last_close": f"coalesce(lead(close, {lookahead}) {b.window()}, last(close) {whole})",
        }
    )


def add_touches(b: Blocked, lookahead: int, prices: dict[str, tuple[str, bool]]) -> Blocked:
    """Step (from 1) at which the next bars first reach each price from below (true) or above, NULL without one."""
    b = b.with_columns({f"{name}_at": price for name, (price, _) in prices.items()})
    ahead = ahead_of(b, lookahead)
    steps = {name: ahead.reach(f"r.{name}_at", upper) for name, (_, upper) in prices.items()}
    return ahead.rows(steps, drop=[f"{name}_at" for name in prices])


def outcome(tp_step: str, sl_step: str) -> str:
    """Exit code; the stop wins when both barriers are touched in one bar."""
    return (
        f"(case when {sl_step} <= coalesce({tp_step}, {sl_step}) then {EXIT_SL} "
        f"when {tp_step} is not null then {EXIT_TP} else {EXIT_TIMEOUT} end)"
    )


def _exit_text(t: str, s: str, tp: str, sl: str, entry: str, side: int | None, params: BarrierParams) -> dict[str, str]:
    """Exit code, price, gross return and bars of a trade; `side` None reads it from `_best`."""
    code = outcome(t, s)
    sign = f"if(_best.side = {LONG}, 1, -1)" if side is None else str(SIDES[side])
    return {
        "code": code,
        "price": f"case {code} when {EXIT_SL} then {entry} * (1 - {sign} * {sl} / 100D) "
        f"when {EXIT_TP} then {entry} * (1 + {sign} * {tp} / 100D) else _last_close end",
        "gross": f"case {code} when {EXIT_SL} then -{sl} when {EXIT_TP} then {tp} "
        f"else {sign} * (_last_close - {entry}) / {entry} * 100 end",
        "held": f"int(case {code} when {EXIT_SL} then {s} when {EXIT_TP} then {t} else {params.lookahead} end)",
    }


def barrier_price(entry: str, pct: str, up: bool) -> str:
    return f"({entry} * (1 {'+' if up else '-'} {pct} / 100D))"


def ratio_test(target: float, stop: float, params: BarrierParams) -> str:
    """Condition on `atr_pct` under which a grid cell's bounded target is at least `min_rr` times its bounded stop.

    The multiples and bounds are decimals, so the ranges are found exactly and written as text: where neither side is
    bounded the ratio is that of the multiples, whatever the last bit of the volatility.
    """
    exact = lambda x: Fraction(repr(float(x)))
    t, s, rr = exact(target), exact(stop), exact(params.min_rr)
    target_ends = exact(params.min_target_pct), exact(params.max_target_pct)
    stop_ends = max(exact(params.min_stop_pct), exact(1e-9)), max(exact(params.max_stop_pct), exact(1e-9))

    def holds(atr: Fraction) -> bool:
        bounded = lambda x, ends: min(max(x, ends[0]), ends[1])
        return bounded(atr * t, target_ends) >= rr * bounded(atr * s, stop_ends)

    # the test can only change where a bound begins or ends to hold, or where a bound is the ratio times the other side
    turns = {e / m for m, ends in ((t, target_ends), (s, stop_ends)) if m > 0 for e in ends}
    turns |= {e / (rr * s) for e in target_ends if rr * s > 0} | {rr * e / t for e in stop_ends if t > 0}
    points = sorted(p for p in turns if p > 0)
    # open ranges and the points between them, in order
    parts = []
    for low, high in zip([Fraction(0), *points], [*points, None], strict=True):
        parts.append((low, high, holds((low + high) / 2 if high is not None else low + 1)))
        if high is not None:
            parts.append((high, high, holds(high)))
    texts, at = [], 0
    while at < len(parts):
        end = at
        while end < len(parts) and parts[end][2]:
            end += 1
        if end > at:
            (low, first, _), (last, high, _) = parts[at], parts[end - 1]
            checks = [] if low == 0 else [f"atr_pct {'>=' if low == first else '>'} {float(low)!r}D"]
            checks += [] if high is None else [f"atr_pct {'<=' if last == high else '<'} {float(high)!r}D"]
            texts.append(f"({' and '.join(checks) or 'true'})")
        at = end + 1
    return f"({' or '.join(texts) or 'false'})"


def barrier_outcomes(
    bars: DataFrame,
    params: BarrierParams = BarrierParams(),
    entry_mode: str = "next_open",
    keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """Outcome of one long and one short trade per bar with the fixed ATR multiples.

    Every bar with volatility and an entry price gets two rows: exit reason, price, gross and net return in
    percent, and bars held. A timeout exits at the close of the last bar in the look-ahead and counts as
    the full look-ahead.
    """
    check_choice("entry_mode", entry_mode, ENTRIES)
    b = in_blocks(
        bars, back=volatility_back(params), ahead=params.lookahead, alphas=volatility_alphas(params), keys=keys
    )
    b = add_next(add_volatility(b, params), params.lookahead)
    base = "_next_open" if entry_mode == "next_open" else "close"
    slip = params.slippage_pct / 100.0

    def bounded(multiple: float, lo: float, hi: float) -> str:
        return f"least(greatest(atr_pct * {multiple!r}D, {lo!r}D), {hi!r}D)"

    b = b.with_columns(
        {
            "take_profit_pct": bounded(params.fixed_tp_multiplier, params.min_target_pct, params.max_target_pct),
            "stop_loss_pct": bounded(params.fixed_sl_multiplier, params.min_stop_pct, params.max_stop_pct),
            **{f"_e{side}": f"{base} * (1 + {sign} * {slip!r}D)" for side, sign in SIDES.items()},
        }
    )
    prices = {}
    for side in SIDES:
        long = side == LONG
        prices[f"_t{side}"] = (barrier_price(f"_e{side}", "take_profit_pct", long), long)
        prices[f"_s{side}"] = (barrier_price(f"_e{side}", "stop_loss_pct", not long), not long)
    b = add_touches(b, params.lookahead, prices)
    rows = b.core().where(f"atr_pct > 0 and {base} is not null")
    sides = ", ".join(
        f"named_struct('sign', {sign}, 'entry_price', _e{side}, '_tp_step', _t{side}, '_sl_step', _s{side})" for side, sign in SIDES.items()
    )
    rows = rows.selectExpr("*", f"inline(array({sides}))")
    rows = rows.selectExpr(
        "*",
        "entry_price * (1 + sign * take_profit_pct / 100D) as _tp",
        "entry_price * (1 - sign * stop_loss_pct / 100D) as _sl",
    )
    rows = rows.selectExpr("*", f"{outcome('_tp_step', '_sl_step')} as exit_code")
    rows = rows.selectExpr(
        "*",
        f"case exit_code when {EXIT_SL} then _sl when {EXIT_TP} then _tp else _last_close end as exit_price",
        f"case exit_code when {EXIT_SL} then -stop_loss_pct when {EXIT_TP} then take_profit_pct "
        "else sign * (_last_close - entry_price) / entry_price * 100 end as gross_return_pct",
        f"int(case exit_code when {EXIT_SL} then _sl_step when {EXIT_TP} then _tp_step "
        f"else {params.lookahead} end) as bars_to_exit",
    )
    rows = rows.withColumns(
        {
            "exit_reason": code_name(F.col("exit_code"), EXIT_NAMES),
            "direction_name": F.when(F.col("sign") == 1, "LONG").otherwise("SHORT"),
            "net_return_pct": F.col("gross_return_pct") - F.lit(params.cost_pct),
        }
    )
    return rows.drop("sign", *[x for x in rows.columns if x.startswith("_")])


def _multiples(params: BarrierParams, mode: str) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Target and stop multiples of the grid."""
    if mode == "fixed_rule":
        return (params.fixed_tp_multiplier,), (params.fixed_sl_multiplier,)
    return params.tp_multipliers, params.sl_multipliers


def add_grid(b: Blocked, params: BarrierParams, mode: str = "oracle_best", entry_mode: str = "next_open") -> Blocked:
    """Entries, bounded barriers and the steps that touch them: what labellings of one mode share.

    Touch steps are found once per barrier level (see `plans/touch.py`).
    """
    check_choice("labeling_mode", mode, MODES)
    check_choice("entry_mode", entry_mode, ENTRIES)
    targets, stops = _multiples(params, mode)
    slip = params.slippage_pct / 100.0
    base = "_next_open" if entry_mode == "next_open" else "close"

    pcts = {f"_tp{i}": f"least(greatest(atr_pct * {m!r}D, {params.min_target_pct!r}D), {params.max_target_pct!r}D)"
            for i, m in enumerate(targets)}
    pcts |= {f"_sl{j}": f"least(greatest(atr_pct * {m!r}D, {params.min_stop_pct!r}D), {params.max_stop_pct!r}D)"
             for j, m in enumerate(stops)}
    entries = {f"_e{side}": f"{base} * {1.0 + sign * slip!r}D" for side, sign in SIDES.items()}
    b = b.with_columns({**pcts, **entries})

    steps = {}
    for side in SIDES:
        long = side == LONG
        for i in range(len(targets)):
            steps[f"_t{side}_{i}"] = (barrier_price(f"_e{side}", f"_tp{i}", long), long)
        for j in range(len(stops)):
            steps[f"_s{side}_{j}"] = (barrier_price(f"_e{side}", f"_sl{j}", not long), not long)
    return add_touches(b, params.lookahead, steps)


def pick_trade(
    b: Blocked,
    params: BarrierParams,
    mode: str = "oracle_best",
    use_sma_filter: bool | str = True,
    entry_mode: str = "next_open",
    keep_all_outcomes: bool = False,
) -> Blocked:
    """Per bar with its grid, the trade with the best net return among those that reach their target.

    Grid cells only compare touch steps. Ties keep the first cell by target, stop, long before short.
    `keep_all_outcomes` (fixed rule only) also accepts losing exits. The side filter may be a boolean column.
    """
    if keep_all_outcomes and mode != "fixed_rule":
        raise ValueError("keep_all_outcomes needs labeling_mode fixed_rule")
    fixed = mode == "fixed_rule"
    targets, stops = _multiples(params, mode)
    base = "_next_open" if entry_mode == "next_open" else "close"
    filtered = use_sma_filter if isinstance(use_sma_filter, str) else str(bool(use_sma_filter)).lower()

    usable = f"atr_pct > 0 and {POS} < {TOTAL} - {params.lookahead} and {base} is not null"
    if not fixed:
        usable += f" and atr_level <= {params.max_atr_ratio!r}D"
    checks = {f"_rr{i}_{j}": ratio_test(t, s, params) for i, t in enumerate(targets) for j, s in enumerate(stops)}
    for side in SIDES:
        checks[f"_ok{side}"] = f"{usable} and (not {filtered} or close {'>' if side == LONG else '<'} sma20_or_close)"
    b = b.with_columns(checks)

    # A cell is (net, order, target, stop, side); the largest net wins and the earliest among equals.
    cells = []
    for i in range(len(targets)):
        for j in range(len(stops)):
            for side in SIDES:
                allowed = f"_ok{side} and _rr{i}_{j}"
                net = f"_tp{i} - {params.cost_pct!r}D"
                if keep_all_outcomes:
                    exits = _exit_text(f"_t{side}_{i}", f"_s{side}_{j}", f"_tp{i}", f"_sl{j}", f"_e{side}", side, params)
                    net = f"{exits['gross']} - {params.cost_pct!r}D"
                else:
                    allowed += f" and _t{side}_{i} < coalesce(_s{side}_{j}, {params.lookahead + 1}) and {net} > 0"
                cells.append(
                    f"case when {allowed} then named_struct('net', {net}, 'place', {-len(cells)}, "
                    f"'i', {i}, 'j', {j}, 'side', {side}) end"
                )
    b = b.with_columns({"_best": f"array_max(array({', '.join(cells)}))"})

    def pick(prefix: str, count: int, index: str) -> str:
        return f"get(array({', '.join(f'{prefix}{k}' for k in range(count))}), {index})"

    def by_side(text: str) -> str:
        return f"case _best.side {' '.join(f'when {side} then {text.format(side=side)}' for side in SIDES)} end"

    b = b.with_columns(
        {
            "_tp": pick("_tp", len(targets), "_best.i"),
            "_sl": pick("_sl", len(stops), "_best.j"),
            "_entry": by_side("_e{side}"),
            "_t": " ".join(["case _best.side", *[f"when {d} then {pick(f'_t{d}_', len(targets), '_best.i')}" for d in SIDES], "end"]),
            "_s": " ".join(["case _best.side", *[f"when {d} then {pick(f'_s{d}_', len(stops), '_best.j')}" for d in SIDES], "end"]),
        }
    )
    exits = _exit_text("_t", "_s", "_tp", "_sl", "_entry", None, params)
    b = b.with_columns({f"_x_{name}": f"case when _best is not null then {text} end" for name, text in exits.items()})
    return b.with_columns(
        {
            "direction_label": f"coalesce(_best.side, {NEUTRAL})",
            "take_profit_pct": "coalesce(_tp, 0D)",
            "stop_loss_pct": "coalesce(_sl, 0D)",
            "expected_return_pct": "coalesce(_best.net, 0D)",
            "time_to_target": f"double(coalesce(_x_held, {params.lookahead}))",
            "magnitude_label": f"coalesce(if(_best.side = {LONG}, _tp, -_tp), 0D)",
            "entry_price": "_entry",
            "exit_price": "_x_price",
            "exit_code": f"coalesce(_x_code, {EXIT_NONE})",
            "bars_to_exit": "coalesce(_x_held, 0)",
            "trade_return_pct": "coalesce(_best.net, 0D)",
            "gross_return_pct": "coalesce(_x_gross, 0D)",
            "net_return_pct": "coalesce(_best.net, 0D)",
            "rr_ratio": "coalesce(_tp / greatest(_sl, 1e-9), 0D)",
            "sma_filter_used": filtered,
            "labeling_mode": f"'{mode}'",
            "entry_mode": f"'{entry_mode}'",
            "label_valid": f"{POS} < {TOTAL} - {params.lookahead}",
        }
    )


def _named(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "direction_name": code_name(F.col("direction_label"), DIRECTION_NAMES),
            "exit_reason": code_name(F.col("exit_code"), EXIT_NAMES),
        }
    ).drop("exit_code")


def trade_labels(
    bars: DataFrame,
    params: BarrierParams = BarrierParams(),
    mode: str = "oracle_best",
    use_sma_filter: bool = True,
    entry_mode: str = "next_open",
    keep_all_outcomes: bool = False,
    keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """Best-trade label per numbered bar, without features; one exchange."""
    b = in_blocks(
        bars, back=volatility_back(params), ahead=params.lookahead, alphas=volatility_alphas(params), keys=keys
    )
    b = add_next(add_volatility(b, params), params.lookahead)
    b = add_grid(b, params, mode, entry_mode)
    b = pick_trade(b, params, mode, use_sma_filter, entry_mode, keep_all_outcomes).drop_scratch()
    return _named(b.core().drop("atr_pct", "atr_level", "sma20_or_close"))


def trade_labels_by_filter(
    bars: DataFrame,
    scenarios: dict[str, bool],
    params: BarrierParams = BarrierParams(),
    mode: str = "oracle_best",
    entry_mode: str = "next_open",
    keep_all_outcomes: bool = False,
    keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """`trade_labels` with and without the side filter (scenario -> use it), in a `scenario` column.

    Volatility, barriers and touches are found once; a bar is copied per scenario only for the choice of its trade.
    """
    b = in_blocks(
        bars, back=volatility_back(params), ahead=params.lookahead, alphas=volatility_alphas(params), keys=keys
    )
    b = add_grid(add_next(add_volatility(b, params), params.lookahead), params, mode, entry_mode)
    each = ", ".join(f"named_struct('scenario', '{name}', '_filtered', {str(used).lower()})" for name, used in scenarios.items())
    b = replace(b, df=b.df.where(CORE).selectExpr("*", f"inline(array({each}))"))
    b = pick_trade(b, params, mode, "_filtered", entry_mode, keep_all_outcomes).drop_scratch()
    return _named(b.core().drop("atr_pct", "atr_level", "sma20_or_close"))


def confirm(labeled: DataFrame, params: ConfirmParams = ConfirmParams()) -> DataFrame:
    """Score each label by the flags that speak for its side and, if enabled, reject the weak ones.

    A rejected label becomes NEUTRAL with its numbers reset (`time_to_target` stays); the original direction
    is kept in `oracle_*`. The first reason that applies is reported.
    """
    present = labeled.columns
    col = F.col
    scored = labeled.withColumns(
        {
            "confirmation_bull_score": count_true(list(BULL_FLAGS), frozenset(), present),
            "confirmation_bear_score": count_true(list(BEAR_FLAGS), BEAR_INVERTED, present),
            "oracle_direction_label": col("direction_label"),
            "oracle_direction_name": col("direction_name"),
            "confirmation_filter_used": F.lit(params.enabled),
        }
    )
    bull, bear = col("confirmation_bull_score"), col("confirmation_bear_score")
    scored = scored.withColumns(
        {
            "confirmation_edge": F.abs(bull - bear),
            "confirmation_score": F.when(col("direction_label") == LONG, bull)
            .when(col("direction_label") == SHORT, bear)
            .otherwise(0.0),
        }
    )
    trade = col("direction_label") != NEUTRAL
    if not params.enabled:
        return scored.withColumn("label_filter_reason", F.when(trade, "filter_disabled").otherwise("oracle_neutral"))

    def holds(flags: tuple[str, ...], inverted: frozenset[str]) -> Column:
        known = [x for x in flags if x in present]
        return count_true(known, inverted, present) == float(len(known))

    required = F.when(col("direction_label") == LONG, holds(params.required_bull, frozenset()))
    required = required.otherwise(holds(params.required_bear, BEAR_INVERTED))
    reason = (
        F.when(~trade, "oracle_neutral")
        .when(~col("label_valid"), "invalid_lookahead_window")
        .when(col("net_return_pct") <= params.min_return_pct, "non_positive_return")
        .when(~required, "missing_required_trend_confirmation")
        .when(col("confirmation_score") < params.min_score, "weak_confirmation")
        .when(col("confirmation_edge") < params.min_edge, "conflicting_confirmation")
        .otherwise("confirmed")
    )
    scored = scored.withColumn("label_filter_reason", reason)
    rejected = ~col("label_filter_reason").isin("oracle_neutral", "confirmed")
    zeroed = [
        "take_profit_pct",
        "stop_loss_pct",
        "expected_return_pct",
        "magnitude_label",
        "trade_return_pct",
        "gross_return_pct",
        "net_return_pct",
        "rr_ratio",
    ]
    reset = {name: F.when(rejected, 0.0).otherwise(col(name)) for name in zeroed}
    reset["bars_to_exit"] = F.when(rejected, 0).otherwise(col("bars_to_exit"))
    reset["direction_label"] = F.when(rejected, NEUTRAL).otherwise(col("direction_label"))
    reset["direction_name"] = F.when(rejected, DIRECTION_NAMES[NEUTRAL]).otherwise(col("direction_name"))
    reset["exit_reason"] = F.when(rejected, EXIT_NAMES[EXIT_NONE]).otherwise(col("exit_reason"))
    reset |= {name: F.when(~rejected, col(name)) for name in ("entry_price", "exit_price")}
    return scored.withColumns(reset)


def label_bars(
    bars: DataFrame,
    params: BarrierParams = BarrierParams(),
    confirm_params: ConfirmParams = ConfirmParams(),
    mode: str = "oracle_best",
    use_sma_filter: bool = True,
    entry_mode: str = "next_open",
    keep_all_outcomes: bool = False,
    groups: tuple[str, ...] = tuple(wide.GROUPS),
    keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """Full labelling of numbered bars: features, flags, best trade and confirmation on one block layout."""
    b = in_blocks(
        with_context(bars, keys=keys),
        back=max(wide.BACK, volatility_back(params)),
        ahead=params.lookahead,
        alphas=volatility_alphas(params),
        keys=keys,
    )
    b = add_next(add_volatility(b, params), params.lookahead)
    b = add_grid(b, params, mode, entry_mode)
    b = pick_trade(b, params, mode, use_sma_filter, entry_mode, keep_all_outcomes).drop_scratch()
    b = b.drop("atr_pct", "atr_level", "sma20_or_close")
    b = wide.add_wide_features(b, groups, conditions=True)
    return confirm(_named(b.core()), confirm_params)
