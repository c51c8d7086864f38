"""DuckDB statements giving the same rows as the registered queries.

They are written row by row (recursion for smoothing, plain whole-series windows) and share no logic with
the block layout of the Spark operators.
"""

from __future__ import annotations

from barloom.functions.names import MODEL_FEATURES

ORACLES: dict[str, str] = {}

W = "over (partition by symbol order by ts)"


FINE = {"sma20": 8, "sma50": 8, "sma200": 8, "entry_price": 8, "exit_price": 8, "pnl_usd": 9, "avg_predicted": 10}


def r6(expr: str, name: str) -> str:
    return f"round({expr}, {FINE.get(name, 6)}) + 0.0 as {name}"


def rolled(*names: str, fine: bool = False) -> str:
    digits = {n: 8 if fine else FINE.get(n, 6) for n in names}
    return ", ".join(f"round({n}, {digits[n]}) + 0.0 as {n}" for n in names)


def statement(ctes: list[str], select: str) -> str:
    return "with recursive " + ",\n".join(ctes) + "\n" + select


def frame(size: int) -> str:
    return f"over (partition by symbol order by ts rows between {size - 1} preceding and current row)"


def roll(fn: str, x: str, size: int, min_periods: int | None = None) -> str:
    need = size if min_periods is None else min_periods
    return f"case when count({x}) {frame(size)} >= {need} then {fn}({x}) {frame(size)} end"


def lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) {W}"


def ewm(name: str, source: str, outs: dict[str, tuple[str, float, int]]) -> list[str]:
    """Recursive smoothing over `rn`: y0 = first value, y = (1-a) y + a x, shown after min_periods values."""
    first, step, show = [], [], []
    for out, (x, a, need) in outs.items():
        first += [f"{x} as y_{out}", f"({x} is not null)::int as k_{out}"]
        step += [
            f"case when s.{x} is null then r.y_{out} when r.y_{out} is null then s.{x} "
            f"else (1.0::double - {a!r}::double) * r.y_{out} + {a!r}::double * s.{x} end",
            f"r.k_{out} + (s.{x} is not null)::int",
        ]
        show.append(f"case when k_{out} >= {need} then y_{out} end as {out}")
    return [
        f"{name}_r as (select symbol, rn, {', '.join(first)} from {source} where rn = 0 union all "
        f"select s.symbol, s.rn, {', '.join(step)} from {name}_r r join {source} s "
        f"on s.symbol = r.symbol and s.rn = r.rn + 1)",
        f"{name} as materialized (select symbol, rn, {', '.join(show)} from {name}_r)",
    ]


PATH = """p as (
  select event_type as symbol, ts, event_id, value,
         1000 + sum(cast(case when event_id % 2 = 0 then value else -value end as decimal(18,2))
                    * cast(0.05 as decimal(4,2)))
                over (partition by event_type order by ts, event_id
                      rows between unbounded preceding and current row) as px
  from events)"""
BARS = """bars as materialized (
  select symbol, date_trunc('hour', p.ts)::timestamp as ts,
         cast(arg_min(px, (ts, event_id)) as double) as open,
         cast(max(px) as double) as high, cast(min(px) as double) as low,
         cast(arg_max(px, (ts, event_id)) as double) as close,
         cast(sum(cast(value as decimal(18,2))) as double) as volume
  from p group by 1, date_trunc('hour', p.ts))"""
BRAND_BARS = """bars as materialized (
  select p_brand as symbol, date_trunc('week', l_shipdate)::timestamp as ts,
         arg_min(price, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) as open,
         max(price) as high, min(price) as low,
         arg_max(price, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) as close,
         sum(l_quantity) as volume
  from (select *, l_extendedprice / l_quantity as price
        from lineitem join part on l_partkey = p_partkey)
  group by 1, 2)"""
NUMBERED = f"""b as materialized (
  select *, row_number() {W} - 1 as rn, count(*) over (partition by symbol) as n from bars)"""
HOURLY = [PATH, BARS, NUMBERED]
BRANDS = [BRAND_BARS, NUMBERED]
OHLCV = "open, high, low, close, volume"
ROUNDED_BARS = rolled("open", "high", "low", "close", "volume")

ORACLES["hourly_event_bars"] = statement(HOURLY, f"select symbol, ts, {ROUNDED_BARS} from bars")
ORACLES["weekly_brand_bars"] = statement(
    BRANDS, f"select symbol, ts, {rolled('open', 'high', 'low', 'close', 'volume', fine=True)} from bars"
)
ORACLES["daily_part_bars"] = f"""
select symbol, ts, {rolled('open', 'high', 'low', 'close', 'volume', fine=True)}
from (select cast(l_partkey as varchar) as symbol, date_trunc('day', l_shipdate)::timestamp as ts,
        arg_min(price, (l_orderkey, l_linenumber, l_extendedprice)) as open, max(price) as high, min(price) as low,
        arg_max(price, (l_orderkey, l_linenumber, l_extendedprice)) as close, sum(l_quantity) as volume
      from (select *, l_extendedprice / l_quantity as price from lineitem) group by 1, 2)"""
ORACLES["candle_payload_bars"] = statement(
    HOURLY,
    f"""select symbol, ts, {rolled("open", "high", "low", "close")},
      {r6("case when extract('hour' from ts) % 6 = 0 then 0.0 else volume end", "volume")}
    from bars where extract('day' from ts) % 5 <> 0""",
)
ORACLES["first_of_duplicate_candles"] = f"""
select symbol, ts, l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_partkey, {rolled("close", "volume")}
from (select p_brand as symbol, l_shipdate as ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice as close,
             l_quantity as volume,
             row_number() over (partition by p_brand, l_shipdate
                                order by l_orderkey, l_linenumber, l_partkey) as nr
      from lineitem join part on l_partkey = p_partkey)
where nr = 1"""
ORACLES["symbols_side_by_side"] = statement(
    [PATH, BARS, BRAND_BARS.replace("bars as", "brand_bars as", 1)],
    """select 'all_events' as symbol, count(*) as bars, min(ts) as first_ts, max(ts) as last_ts from bars
    union all select 'all_brands', count(*), min(ts), max(ts) from brand_bars""",
)
ORACLES["bars_through_files"] = statement(
    HOURLY,
    f"""select symbol, count(*) as bars, max(ts) as last_ts,
      {r6("cast(sum(cast(close as decimal(18,4))) as double)", "close_sum")}, format
    from bars, (values ('parquet'), ('csv')) f(format) group by symbol, format""",
)
ORACLES["bar_contract"] = statement(
    HOURLY,
    """select symbol, count(*) as bars,
      count(*) filter (open is null or high is null or low is null or close is null) as null_price,
      count(*) filter (least(open, high, low, close) <= 0) as non_positive_price,
      count(*) filter (high < low) as high_below_low,
      count(*) - count(distinct ts) as duplicate_ts,
      count(*) filter (volume is null) as null_volume
    from bars group by symbol""",
)
ORACLES["bar_freshness"] = statement(
    HOURLY,
    """select symbol, max(ts) as last_ts,
      cast(epoch(timestamp '2024-01-31 01:30:00') - epoch(max(ts)) as bigint) as age_seconds,
      epoch(timestamp '2024-01-31 01:30:00') - epoch(max(ts)) >= 14400 as stale
    from bars group by symbol""",
)
ORACLES["backfill_manifest"] = statement(
    HOURLY
    + [
        """slots as (
      select symbol, t as ts, cast(floor(epoch(t - timestamp '2024-01-01') / 604800) as bigint) as chunk
      from (select symbol from bars union select p_brand from part),
           (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-30 23:00:00',
                                          interval 1 hour)) as t))"""
    ],
    """select symbol, chunk, timestamp '2024-01-01' + to_days(cast(chunk * 7 as int)) as chunk_start,
      least(timestamp '2024-01-01' + to_days(cast(chunk * 7 + 7 as int)), timestamp '2024-01-31') as chunk_end,
      count(*) as expected, count(b.ts) as present, count(*) - count(b.ts) as missing
    from slots left join bars b using (symbol, ts) group by symbol, chunk""",
)
ORACLES["bar_positions"] = statement(HOURLY, "select symbol, ts, rn, n from b")

AHEAD = "over (partition by symbol order by ts rows between 1 following and 20 following)"
LABELED = f"""lab0 as (
  select *,
    cast(least(greatest(coalesce(case when close > 0 then (max(high) {AHEAD} - close) / close * 100 else 0 end, 0),
         0), 100) as float) as upside_max_return,
    cast(least(greatest(coalesce(case when close > 0 then (close - min(low) {AHEAD}) / close * 100 else 0 end, 0),
         0), 100) as float) as downside_max_return
  from b),
lab as materialized (
  select *, case when upside_max_return >= downside_max_return then upside_max_return
                 else -downside_max_return end as max_return,
    rn < n - 20 as horizon_label_valid,
    least(upside_max_return, 5.0::float) as y_up, least(downside_max_return, 5.0::float) as y_dn,
    case when least(upside_max_return, 5.0::float) >= least(downside_max_return, 5.0::float)
         then 1.0::double else 0.0::double end as y_dir
  from lab0)"""
ORACLES["horizon_labels"] = statement(
    HOURLY + [LABELED],
    f"""select symbol, ts, {ROUNDED_BARS}, rn, {rolled("upside_max_return::double", "downside_max_return::double", "max_return::double")
        .replace("as upside_max_return::double", "as upside_max_return")
        .replace("as downside_max_return::double", "as downside_max_return")
        .replace("as max_return::double", "as max_return")},
      horizon_label_valid from lab""",
)
ORACLES["direction_targets"] = statement(
    HOURLY + [LABELED],
    f"select symbol, ts, {r6('y_up::double', 'y_up')}, {r6('y_dn::double', 'y_dn')}, {r6('y_dir', 'y_dir')} from lab",
)
BOUNDS = "cast(floor((n - 20) * 0.7::double) as bigint) as train_end, cast(floor((n - 20) * 0.85::double) as bigint) as val_end"
ORACLES["split_bounds"] = statement(
    HOURLY,
    f"select symbol, greatest(n - 20, 0) as labelled, {BOUNDS} from (select symbol, max(n) as n from b group by symbol)",
)
SPLIT = f"""sp as materialized (
  select *, case when rn < 59 then null when rn < train_end - 20 then 'train'
                 when rn >= train_end and rn < val_end - 20 then 'val'
                 when rn >= val_end then 'test' end as split
  from (select *, {BOUNDS} from lab where horizon_label_valid))"""
ORACLES["purged_split"] = statement(HOURLY + [LABELED, SPLIT], "select symbol, ts, rn, split from sp")
ORACLES["split_summary"] = statement(
    HOURLY + [LABELED, SPLIT],
    f"""select symbol, split, count(*) as windows, cast(sum(y_dir) as bigint) as up_bars,
      count(*) - cast(sum(y_dir) as bigint) as down_bars, {r6("sum(y_dir) / count(*) * 100", "up_pct")},
      {r6("(count(*) - sum(y_dir)) / count(*) * 100", "down_pct")},
      {r6("avg(greatest(y_up, y_dn)::double)", "mean_move")},
      count(*) filter (greatest(y_up, y_dn) > 1.0) as big_moves
    from sp where split is not null group by symbol, split""",
)

MOVES = f"""mv as materialized (
  select *,
    greatest(high - low, abs(high - pc), abs(low - pc)) as tr,
    greatest(close - pc, 0.0) + case when pc is null then null else 0.0 end as gain,
    greatest(pc - close, 0.0) + case when pc is null then null else 0.0 end as loss,
    case when high - ph > pl - low and high - ph > 0 then high - ph else 0.0 end as pdm,
    case when pl - low > high - ph and pl - low > 0 then pl - low else 0.0 end as ndm,
    ln(close / pc) as lr1, close / pc - 1 as ret, nullif(high - low, 0) as rng
  from (select *, {lag("close", 1)} as pc, {lag("high", 1)} as ph, {lag("low", 1)} as pl from b))"""


def span(n: int) -> float:
    return 2.0 / (n + 1.0)


def model_feature_ctes() -> list[str]:
    smooth = {f"ema{n}": ("close", span(n), n) for n in (9, 12, 21, 26, 50)}
    smooth |= {k: (x, 1.0 / 14, 14) for k, x in (("atr", "tr"), ("ag", "gain"), ("al", "loss"))}
    return [
        MOVES,
        *ewm("e1", "mv", smooth),
        "m1 as materialized (select *, ema12 - ema26 as line from e1)",
        *ewm("e2", "m1", {"sig": ("line", span(9), 9)}),
        f"""ft as materialized (
      select symbol, ts, rn, n,
        least(greatest(coalesce(abs(close - open) / rng, 0.0), 0), 1) as body_pct,
        least(greatest(coalesce((high - greatest(open, close)) / rng, 0.0), 0), 1) as upper_shadow_pct,
        least(greatest(coalesce((least(open, close) - low) / rng, 0.0), 0), 1) as lower_shadow_pct,
        coalesce(atr / close * 100, 0.0) as natr,
        coalesce(rng / nullif(atr, 0), 1.0) as candle_vs_atr,
        coalesce(lr1, 0.0) as log_return_1,
        coalesce((close / {lag("close", 6)} - 1) * 100, 0.0) as roc_6,
        coalesce((close - ema21) / ema21 * 100, 0.0) as dist_ema_21_pct,
        coalesce((ema9 - ema21) / ema21 * 100, 0.0) as ema_9_21_spread_pct,
        coalesce((close - ema50) / ema50 * 100, 0.0) as dist_ema_50_pct,
        coalesce((line - sig) / close * 100, 0.0) as macd_hist_pct,
        coalesce(100 - 100 / (1 + ag / (al + 1e-9)), 50.0) as rsi_14,
        least(greatest(coalesce((close - (mid - 2 * sd)) / ((mid + 2 * sd) - (mid - 2 * sd) + 1e-9), 0.5), 0), 1)
          as bb_position,
        coalesce(volume / (avg(volume) {frame(20)} + 1e-9), 1.0) as volume_ratio_20,
        sin(2 * pi() * (extract('hour' from ts) + extract('minute' from ts) / 60.0) / 24) as hour_sin,
        cos(2 * pi() * (extract('hour' from ts) + extract('minute' from ts) / 60.0) / 24) as hour_cos,
        sin(2 * pi() * (extract('isodow' from ts) - 1) / 7) as dow_sin,
        cos(2 * pi() * (extract('isodow' from ts) - 1) / 7) as dow_cos
      from (select mv.*, {roll("avg", "close", 20)} as mid, {roll("stddev_samp", "close", 20)} as sd from mv)
      join m1 using (symbol, rn) join e2 using (symbol, rn))""",
    ]


ORACLES["model_features"] = statement(
    HOURLY + model_feature_ctes(), f"select symbol, ts, {rolled(*MODEL_FEATURES)} from ft"
)
ORACLES["brand_model_features"] = statement(
    BRANDS + model_feature_ctes(), f"select symbol, ts, {rolled(*MODEL_FEATURES)} from ft"
)
SCALER = f"""sc as materialized (
  select symbol, {", ".join(f"avg({f}) as mean_{f}" for f in MODEL_FEATURES)},
    {", ".join(f"case when stddev_pop({f}) = 0 then 1 else stddev_pop({f}) end as scale_{f}" for f in MODEL_FEATURES)}
  from ft join sp using (symbol, rn) where rn < train_end group by symbol)"""
SCALED = f"""z as materialized (
  select symbol, ft.ts as ts, rn, split,
    {", ".join(f"coalesce(({f} - mean_{f}) / scale_{f}, 0) as {f}" for f in MODEL_FEATURES)}
  from ft join sp using (symbol, rn) join sc using (symbol))"""
DATASET = HOURLY + [LABELED, SPLIT] + model_feature_ctes() + [SCALER]
ORACLES["scaler_statistics"] = statement(
    DATASET,
    f"select symbol, {rolled(*[f'{tag}_{f}' for f in MODEL_FEATURES for tag in ('mean', 'scale')])} from sc",
)
ORACLES["standardized_features"] = statement(
    DATASET + [SCALED], f"select symbol, ts, split, {rolled(*MODEL_FEATURES)} from z"
)
ORACLES["training_sequences"] = statement(
    DATASET + [SCALED],
    f"""select symbol, ts, split, cast(60 as bigint) as steps, cast(18 as bigint) as width,
      {r6("round(oldest, 3)", "oldest_rsi")}, {r6("round(newest, 3)", "newest_rsi")}, {r6("round(total, 2)", "rsi_total")}
    from (select *, rsi_14::float::double as newest, lag(rsi_14, 59) {W}::float::double as oldest,
            sum(rsi_14::float::double) {frame(60)} as total from z)
    where split is not null""",
)

# Coarser bars and context


def resampled(name: str, seconds: int) -> str:
    label = f"make_timestamp(cast(ceil(epoch(ts) / {seconds}) * {seconds} as bigint) * 1000000)"
    return f"""{name} as materialized (
  select symbol, {label} as ts, arg_min(open, ts) as open, max(high) as high, min(low) as low,
    arg_max(close, ts) as close, sum(volume) as volume
  from bars group by 1, 2)"""


ORACLES["resampled_four_hour_bars"] = statement(
    HOURLY + [resampled("h4", 14400)], f"select symbol, ts, {ROUNDED_BARS} from h4"
)


def s_div(a: str, b: str) -> str:
    return f"(({a}) / (({b}) + 1e-9))"


def moves_cte(name: str, source: str) -> str:
    return MOVES.replace("mv as", f"{name} as", 1).replace("from b))", f"from {source}))")


def numbered_cte(name: str, source: str) -> str:
    return f"{name} as materialized (select *, row_number() {W} - 1 as rn from {source})"


def rsi_sql(n: int) -> str:
    return f"(100 - 100 / (1 + {s_div(f'g{n}', f'l{n}')}))"


def smoothing(periods, rsis) -> dict[str, tuple[str, float, int]]:
    out = {f"ema{n}": ("close", span(n), n) for n in periods}
    out |= {k: (x, 1.0 / 14, 14) for k, x in (("atr", "tr"), ("p14", "pdm"), ("n14", "ndm"))}
    for n in rsis:
        out |= {f"g{n}": ("gain", 1.0 / n, n), f"l{n}": ("loss", 1.0 / n, n)}
    return out


def dmi_cte(name: str, source: str) -> str:
    return f"""{name} as materialized (
  select *, abs(dmp - dmn) / (dmp + dmn + 1e-9) * 100 as dx
  from (select *, 100 * {s_div("p14", "atr")} as dmp, 100 * {s_div("n14", "atr")} as dmn from {source}))"""


CONTEXT = ["log_return_1", "natr", "dist_ema_9", "dist_ema_21", "dist_ema_50", "ema_9_21_spread",
           "ema_21_50_spread", "trend_regime", "rsi_14", "rsi_slope_7_21", "adx", "bb_position", "volume_surprise"]


def context_ctes(tag: str, seconds: int) -> list[str]:
    f = f"{tag}_"
    return [
        resampled(f + "raw", seconds),
        numbered_cte(f + "b", f + "raw"),
        moves_cte(f + "mv", f + "b"),
        *ewm(f + "e1", f + "mv", smoothing((9, 21, 50), (7, 14, 21))),
        dmi_cte(f + "d", f + "e1"),
        *ewm(f + "e2", f + "d", {"adx": ("dx", 1.0 / 14, 14)}),
        f"""{f}ft as materialized (
      select symbol, ts, lr1 as log_return_1, {s_div("atr", "close")} * 100 as natr,
        {", ".join(f"{s_div(f'close - ema{n}', f'ema{n}')} as dist_ema_{n}" for n in (9, 21, 50))},
        {s_div("ema9 - ema21", "ema21")} as ema_9_21_spread, {s_div("ema21 - ema50", "ema50")} as ema_21_50_spread,
        sign(close - ema21)::double as trend_regime, {rsi_sql(14)} as rsi_14,
        {s_div(f"{rsi_sql(7)} - {rsi_sql(21)}", "100")} as rsi_slope_7_21, adx,
        {s_div("close - (mid - 2 * sd)", "(mid + 2 * sd) - (mid - 2 * sd)")} as bb_position,
        {s_div("volume - vm", "vs")} as volume_surprise
      from (select *, {roll("avg", "close", 20)} as mid, {roll("stddev_samp", "close", 20)} as sd,
              {roll("avg", "volume", 20)} as vm, {roll("stddev_samp", "volume", 20)} as vs from {f}mv)
      join {f}e1 using (symbol, rn) join {f}e2 using (symbol, rn))""",
        f"""{f}lagged as materialized (
      select symbol, ts, {", ".join(f"{lag(n, 1)} as mtf_{tag}_{n}" for n in CONTEXT)} from {f}ft)""",
        f"""{f}ctx as materialized (
      select b.symbol, b.rn, {", ".join(f"mtf_{tag}_{n}" for n in CONTEXT)}
      from b asof left join {f}lagged c on b.symbol = c.symbol and b.ts >= c.ts)""",
    ]


CTX = context_ctes("4h", 14400) + context_ctes("1d", 86400)
MTF = [f"mtf_{tag}_{n}" for tag in ("4h", "1d") for n in CONTEXT]
ORACLES["higher_timeframe_context"] = statement(
    HOURLY + [c.replace("4h_", "h4_").replace("mtf_h4_", "mtf_4h_").replace("1d_", "d1_").replace("mtf_d1_", "mtf_1d_")
              for c in CTX],
    f"select symbol, b.ts, {rolled(*MTF)} from b join h4_ctx using (symbol, rn) join d1_ctx using (symbol, rn)",
)
CTX = [c.replace("4h_", "h4_").replace("mtf_h4_", "mtf_4h_").replace("1d_", "d1_").replace("mtf_d1_", "mtf_1d_")
       for c in CTX]

# Wide features


def wma(x: str, n: int) -> str:
    parts = [f"{n - k} * {x if k == 0 else lag(x, k)}" for k in range(n)]
    return f"(({' + '.join(parts)}) / {n * (n + 1) / 2})"


AVERAGES = {"sma20": 20, "sma50": 50, "sma200": 200, "ema5": 5, "ema9": 9, "ema20": 20, "ema50": 50, "ema200": 200,
            "hma9": 9, "hma21": 21, "hma50": 50}
SMOOTH = [MOVES, *ewm("e1", "mv", smoothing((5, 9, 12, 20, 21, 26, 50, 200), (7, 14, 21)))]
HULL = [
    f"""raw_hull as materialized (select symbol, ts, rn, close,
      {", ".join(f"2 * {wma('close', h)} - {wma('close', n)} as raw{n}" for n, h in ((9, 4), (21, 10), (50, 25)))},
      {", ".join(f"{roll('avg', 'close', n)} as sma{n}" for n in (20, 50, 200))} from b)""",
    f"""avgs as materialized (select symbol, ts, rn, sma20, sma50, sma200,
      {", ".join(f"{wma(f'raw{n}', s)} as hma{n}" for n, s in ((9, 3), (21, 4), (50, 7)))} from raw_hull)""",
]


def gap_pct(a: str, base: str) -> str:
    return f"coalesce(({a} - {base}) / greatest({base}, 1e-9) * 100, 0)"


MA_STATUS = f"""ma as materialized (
  select symbol, ts, rn, {", ".join(AVERAGES)},
    {", ".join(f"coalesce(close > {m}, false) as price_above_{m}" for m in AVERAGES)},
    {", ".join(f"{gap_pct('close', m)} as dist_{m}_pct" for m in AVERAGES)},
    {", ".join(f"{gap_pct(m, lag(m, max(1, p // 4)))} as slope_{m}_pct" for m, p in AVERAGES.items())},
    {", ".join(f"{gap_pct(a, z)} as {a}_vs_{z}_pct" for a, z in (("sma20", "sma50"), ("sma50", "sma200"), ("ema50", "sma200")))}
  from b join e1 using (symbol, rn) join (select * exclude (ts) from avgs) using (symbol, rn))"""
MA_DOUBLES = (
    list(AVERAGES) + [f"dist_{m}_pct" for m in AVERAGES] + [f"slope_{m}_pct" for m in AVERAGES]
    + ["sma20_vs_sma50_pct", "sma50_vs_sma200_pct", "ema50_vs_sma200_pct"]
)
ORACLES["moving_average_status"] = statement(
    HOURLY + SMOOTH + HULL + [MA_STATUS],
    f"select symbol, ts, {rolled(*MA_DOUBLES)}, {', '.join(f'price_above_{m}' for m in AVERAGES)} from ma",
)


def high(n: int) -> str:
    return roll("max", "high", n)


def low(n: int) -> str:
    return roll("min", "low", n)


BB = "(mid + 2 * sd) - (mid - 2 * sd)"
TECHNICAL = [
    dmi_cte("dm", "e1"),
    "ml as materialized (select *, ema12 - ema26 as macd from dm)",
    *ewm("e2", "ml", {"macd_signal": ("macd", span(9), 9), "adx": ("dx", 1.0 / 14, 14)}),
    f"""t1 as materialized (
  select mv.*, ml.* exclude (symbol, rn), macd_signal, adx, hma9, hma21, hma50, sma20, sma50, sma200,
    {roll("avg", "mv.close", 20)} as mid, {roll("stddev_samp", "mv.close", 20)} as sd,
    {", ".join(f"{high(n)} as hi{n}, {low(n)} as lo{n}" for n in (6, 24, 72))},
    {", ".join(f"{roll('avg', 'volume', n)} as v{n}" for n in (5, 10, 20, 50))},
    {roll("stddev_samp", "volume", 50)} as vs50,
    {roll("stddev_samp", "lr1", 12)} as realized_vol_12, {roll("stddev_samp", "lr1", 24)} as realized_vol_24,
    {roll("avg", "lr1", 5)} - {roll("avg", "lr1", 20)} as momentum_slope,
    {roll("sum", "(high + low + close) / 3 * volume", 20)} / ({roll("sum", "volume", 20)} + 1e-9) as vwap,
    sum(coalesce(sign(close - pc), 0) * volume) over (partition by symbol order by ts) as obv,
    {s_div("ret - " + roll("avg", "ret", 20), roll("stddev_samp", "ret", 20))} as surprise_20,
    {roll("sum", "ret * volume", 10)} as moved,
    {roll("avg", s_div("close - low", "high - low"), 10)} as avg_close_pos_10,
    {rsi_sql(7)} as rsi_7, {rsi_sql(14)} as rsi_14, {rsi_sql(21)} as rsi_21
  from mv join ml using (symbol, rn) join e2 using (symbol, rn) join (select * exclude (ts) from avgs) using (symbol, rn))""",
    f"""t2 as materialized (
  select *, {s_div(BB, "close")} as bb_width,
    {s_div("rsi_14 - " + roll("min", "rsi_14", 14), f"{roll('max', 'rsi_14', 14)} - {roll('min', 'rsi_14', 14)}")} * 100
      as stochrsi_k,
    list(realized_vol_24) {frame(100)} as rvs
  from t1)""",
    f"""tf as materialized (
  select *,
    {", ".join(f"ln(close / {lag('close', k)}) as log_return_{k}" for k in (1, 3, 6, 12, 24))},
    {", ".join(f"(close / {lag('close', k)} - 1) * 100 as roc_{k}" for k in (3, 6, 12, 24))},
    {s_div("atr", "close")} * 100 as natr,
    {s_div("realized_vol_24", roll("avg", "realized_vol_24", 72))} as volatility_regime_72,
    {s_div("atr", roll("avg", "atr", 100))} as atr_ratio, {s_div("rsi_7 - rsi_21", "100")} as rsi_slope_7_21,
    {roll("avg", "stochrsi_k", 3)} as stochrsi_d,
    {", ".join(f"{s_div(f'close - ema{n}', f'ema{n}')} as dist_ema_{n}" for n in (5, 9, 20, 21, 50))},
    {", ".join(f"{s_div(f'close - hma{n}', f'hma{n}')} as dist_hma_{n}" for n in (9, 21))},
    {", ".join(f"{s_div(f'{k}{a} - {k}{z}', f'{k}{z}')} as {k}_{a}_{z}_spread"
               for k, a, z in (("ema", 5, 20), ("ema", 9, 21), ("ema", 21, 50), ("hma", 9, 21)))},
    sign(close - ema21)::double as trend_regime, macd - macd_signal as macd_hist,
    {s_div("close - (mid - 2 * sd)", BB)} as bb_position,
    {s_div("volume", "v5")} as volume_ratio_5, {s_div("volume", "v10")} as volume_ratio_10,
    {s_div("volume", "v20")} as vol_ratio_20,
    {s_div("abs(close - open)", "rng")} as candle_directional_score, {s_div("abs(close - open)", "rng")} as body_pct_range,
    {s_div("close - lo6", "hi6 - lo6")} as micro_position_6, {s_div("close - lo24", "hi24 - lo24")} as intraday_position,
    {s_div("close - low", "rng")} as buy_pressure,
    {s_div("(high - greatest(open, close)) - (least(open, close) - low)", "rng")} as wick_imbalance,
    {s_div("high - low", "atr")} as candle_vs_atr,
    {", ".join(f"{s_div(f'close - hi{n}', f'hi{n}')} as dist_high_{n}, {s_div(f'close - lo{n}', f'lo{n}')} as dist_low_{n}"
               for n in (24, 72))},
    {s_div("close - vwap", "vwap")} as price_to_vwap, {s_div("volume - v50", "vs50")} as volume_surprise_50,
    {s_div("v5 - v20", "v20")} as vol_trend_5_20,
    {s_div("obv - " + lag("obv", 20), "close * v20")} as obv_slope_20,
    {s_div("abs(close - " + lag("close", 10) + ")", roll("sum", "rng", 10))} as efficiency_ratio_10,
    {s_div(roll("avg", "rng", 10), roll("avg", "rng", 50))} as range_compression_10_50,
    {s_div("moved", roll("stddev_samp", "moved", 50))} as volume_momentum_norm,
    case when {s_div("bb_width", roll("avg", "bb_width", 50))} < 0.5 then 1.0::double else 0.0::double end as bb_squeeze,
    case when rn >= 123 then (len(list_filter(rvs, lambda x: x < realized_vol_24))
      + (len(list_filter(rvs, lambda x: x = realized_vol_24)) + 1) / 2.0) / 100.0 end as vol_percentile_100,
    sin(2 * pi() * extract('hour' from ts) / 24) as hour_sin, cos(2 * pi() * extract('hour' from ts) / 24) as hour_cos,
    sin(2 * pi() * (extract('isodow' from ts) - 1) / 7) as dow_sin,
    cos(2 * pi() * (extract('isodow' from ts) - 1) / 7) as dow_cos,
    {lag("ema5", 1)} as ema5_1, {lag("ema20", 1)} as ema20_1, {lag("hma9", 1)} as hma9_1, {lag("hma21", 1)} as hma21_1
  from t2)""",
]
TECHNICAL_COLUMNS = (
    [f"log_return_{k}" for k in (1, 3, 6, 12, 24)] + [f"roc_{k}" for k in (3, 6, 12, 24)]
    + ["atr", "natr", "realized_vol_12", "realized_vol_24", "volatility_regime_72", "atr_ratio", "rsi_7", "rsi_14",
       "rsi_21", "rsi_slope_7_21", "stochrsi_k", "stochrsi_d", "ema5", "ema9", "ema20", "ema21", "ema50", "ema200",
       "sma50", "sma200", "hma9", "hma21", "hma50", "dist_ema_5", "dist_ema_9", "dist_ema_20", "dist_ema_21",
       "dist_ema_50", "dist_hma_9", "dist_hma_21", "ema_5_20_spread", "ema_9_21_spread", "ema_21_50_spread",
       "hma_9_21_spread", "trend_regime", "macd", "macd_signal", "macd_hist", "adx", "dmp", "dmn", "bb_width",
       "bb_position", "momentum_slope", "volume_ratio_5", "volume_ratio_10", "vol_ratio_20",
       "candle_directional_score", "body_pct_range", "micro_position_6", "intraday_position", "buy_pressure",
       "wick_imbalance", "candle_vs_atr", "dist_high_24", "dist_low_24", "dist_high_72", "dist_low_72", "vwap",
       "price_to_vwap", "volume_surprise_50", "vol_trend_5_20", "obv_slope_20", "efficiency_ratio_10",
       "range_compression_10_50", "surprise_20", "volume_momentum_norm", "avg_close_pos_10", "bb_squeeze",
       "vol_percentile_100", "hour_sin", "hour_cos", "dow_sin", "dow_cos"]
)
WIDE = HOURLY + SMOOTH + HULL + TECHNICAL
ORACLES["technical_features"] = statement(WIDE, f"select symbol, ts, {rolled(*TECHNICAL_COLUMNS)} from tf")
SPARSE = ["candle_directional_score", "buy_pressure", "wick_imbalance", "efficiency_ratio_10", "range_compression_10_50"]
FILLED_COLUMNS = [c for c in TECHNICAL_COLUMNS if not c.startswith(("ema", "sma", "hma"))]
ORACLES["filled_features"] = statement(
    WIDE,
    "select symbol, ts, "
    + ", ".join(
        r6(f"coalesce(last_value({c} ignore nulls) {frame(10**9)}, 0)", c) for c in FILLED_COLUMNS
    )
    + " from tf",
)


def cross(up: bool, a: str, b: str) -> str:
    x, y = (">", "<=") if up else ("<", ">=")
    return f"{a} {x} {b} and {a}_1 {y} {b}_1"


FLAGS = {
    "rsi14_oversold": "rsi_14 < 30", "rsi14_neutral": "rsi_14 between 30 and 70", "rsi14_overbought": "rsi_14 > 70",
    "macd_bullish": "macd > macd_signal", "macd_bearish": "macd < macd_signal",
    "macd_hist_positive": "macd_hist > 0", "macd_hist_negative": "macd_hist < 0",
    "adx_strong": "adx >= 25", "adx_weak": "adx < 20", "dmp_above_dmn": "dmp > dmn", "dmn_above_dmp": "dmn > dmp",
    "bb_lower_zone": "bb_position < 0.2", "bb_middle_zone": "bb_position between 0.2 and 0.8",
    "bb_upper_zone": "bb_position > 0.8", "bb_squeeze": "bb_squeeze > 0", "stochrsi_oversold": "stochrsi_k < 20",
    "stochrsi_overbought": "stochrsi_k > 80", "stochrsi_k_above_d": "stochrsi_k > stochrsi_d",
    "volume_surprise_high": "volume_surprise_50 > 1", "volume_surprise_low": "volume_surprise_50 < -1",
    "roc3_positive": "roc_3 > 0", "roc3_negative": "roc_3 < 0", "ema9_above_ema21": "ema9 > ema21",
    "ema5_above_ema20": "ema5 > ema20", "ema5_cross_above_ema20": cross(True, "ema5", "ema20"),
    "ema5_cross_below_ema20": cross(False, "ema5", "ema20"), "ema21_above_ema50": "ema21 > ema50",
    "ema50_above_ema200": "ema50 > ema200", "sma50_above_sma200": "sma50 > sma200",
    "price_above_hma9": "close > hma9", "price_below_hma9": "close < hma9", "hma9_above_hma21": "hma9 > hma21",
    "hma9_cross_above_hma21": cross(True, "hma9", "hma21"), "hma9_cross_below_hma21": cross(False, "hma9", "hma21"),
    "trend_regime_up": "close > ema21", "trend_regime_down": "close < ema21", "rsi_rising": "rsi_slope_7_21 > 0",
    "rsi_falling": "rsi_slope_7_21 < 0", "momentum_up": "momentum_slope > 0", "momentum_down": "momentum_slope < 0",
    "roc12_positive": "roc_12 > 0", "roc12_negative": "roc_12 < 0", "above_vwap": "close > vwap",
    "below_vwap": "close < vwap", "obv_rising": "obv_slope_20 > 0", "obv_falling": "obv_slope_20 < 0",
    **{f"mtf_{t}_trend_{d}": f"mtf_{t}_trend_regime {o} 0" for t in ("4h", "1d") for d, o in (("up", ">"), ("down", "<"))},
    **{f"mtf_{t}_rsi_{d}": f"mtf_{t}_rsi_14 {o} 50" for t in ("4h", "1d") for d, o in (("bullish", ">"), ("bearish", "<"))},
}
CONDITIONS = f"""cond as materialized (
  select symbol, tf.ts, rn, {", ".join(f"coalesce({e}, false) as condition_{n}" for n, e in FLAGS.items())}
  from tf join h4_ctx using (symbol, rn) join d1_ctx using (symbol, rn))"""
ORACLES["condition_flags"] = statement(
    WIDE + CTX + [CONDITIONS], f"select symbol, ts, {', '.join(f'condition_{n}' for n in FLAGS)} from cond"
)

SWINGS = f"""sw as materialized (select *, {lag("close", 1)} as c1, {lag("high", 2)} as h2, {lag("low", 2)} as l2,
  nullif(high - low, 0) as rng,
  {", ".join(f"{high(n)} as hi{n}, {low(n)} as lo{n}" for n in (5, 10, 20, 48, 96, 192))} from b)"""


def one(cond: str) -> str:
    return f"case when {cond} then 1.0::double else 0.0::double end"


STRUCTURE = f"""ms as materialized (
  select *, bos_bull_20 * {one("hi20 < " + lag("hi20", 20))} as choch_bull,
    bos_bear_20 * {one("lo20 > " + lag("lo20", 20))} as choch_bear
  from (select *,
    {", ".join(f"{one(f'close > {lag(f'hi{n}', 1)} and c1 <= {lag(f'hi{n}', 2)}')} as bos_bull_{n}, "
               f"{one(f'close < {lag(f'lo{n}', 1)} and c1 >= {lag(f'lo{n}', 2)}')} as bos_bear_{n}" for n in (5, 10, 20, 48))},
    {", ".join(f"{one(f'hi{n} > {lag(f'hi{n}', n)} and lo{n} > {lag(f'lo{n}', n)}')} as struct_bullish_{n}, "
               f"{one(f'hi{n} < {lag(f'hi{n}', n)} and lo{n} < {lag(f'lo{n}', n)}')} as struct_bearish_{n}" for n in (20, 48))},
    {one("low > h2")} as fvg_bull, {one("high < l2")} as fvg_bear,
    coalesce(case when low > h2 then low - h2 else 0 end / close * 100, 0) as fvg_bull_size,
    coalesce(case when l2 > high then l2 - high else 0 end / close * 100, 0) as fvg_bear_size,
    coalesce({s_div("rng", roll("avg", "rng", 20))}, 1) as displacement,
    {", ".join(f"coalesce({s_div(f'close - lo{n}', f'hi{n} - lo{n}')}, 0.5) as pd_zone_{n}" for n in (96, 192))}
  from sw))"""
STRUCTURE_COLUMNS = (
    [f"bos_{d}_{n}" for n in (5, 10, 20, 48) for d in ("bull", "bear")]
    + [f"struct_{d}_{n}" for n in (20, 48) for d in ("bullish", "bearish")]
    + ["choch_bull", "choch_bear", "fvg_bull", "fvg_bear", "fvg_bull_size", "fvg_bear_size", "displacement",
       "pd_zone_96", "pd_zone_192"]
)
ORACLES["market_structure"] = statement(
    HOURLY + [SWINGS, STRUCTURE], f"select symbol, ts, {rolled(*STRUCTURE_COLUMNS)} from ms"
)

# Barrier labels

VOLATILITY = [
    f"""tr0 as materialized (
  select *, greatest(high - low, abs(high - pc), abs(low - pc)) as tr
  from (select *, {lag("close", 1)} as pc from b))""",
    *ewm("av", "tr0", {"watr": ("tr", 1.0 / 14, 14)}),
    f"""vol as materialized (
  select *, case when rn >= 99 and avg(atr_pct) {frame(100)} > 0 then atr_pct / avg(atr_pct) {frame(100)} else 1 end
      as atr_level,
    coalesce({roll("avg", "close", 20)}, close) as sma20_or_close,
    lead(open) {W} as next_open,
    coalesce(last_value(close) {AHEAD}, close) as last_close,
    list({{'h': high, 'l': low}}) {AHEAD} as path
  from (select tr0.*, coalesce(watr / close * 100, 0) as atr_pct from tr0 join av using (symbol, rn)))""",
]
GRID = "grid as (select tp_i, tp_m, sl_i, sl_m, side from (values (0, 1.0), (1, 1.5), (2, 2.0), (3, 3.0)) t(tp_i, tp_m), (values (0, 0.5), (1, 0.75), (2, 1.0)) s(sl_i, sl_m), (values (0), (2)) d(side))"
FIXED = "grid as (select 0 as tp_i, 1.0 as tp_m, 0 as sl_i, 0.5 as sl_m, side from (values (0), (2)) d(side))"
COST = "0.14::double"


def outcome_ctes(entry: str) -> list[str]:
    """Every bar x grid cell: walk the next bars and take the first one that touches a barrier."""
    return [
        f"""cells as materialized (
  select v.*, g.*, least(greatest(atr_pct * tp_m::double, 0.1), 10.0) as tp,
    least(greatest(atr_pct * sl_m::double, 0.05), 5.0) as sl,
    {entry} * (case when side = 0 then 1.0::double + 0.0002::double else 1.0::double - 0.0002::double end) as entry
  from vol v, grid g where atr_pct > 0 and {entry} is not null)""",
        """priced as (
  select *, case when side = 0 then entry * (1 + tp / 100) else entry * (1 - tp / 100) end as tp_price,
            case when side = 0 then entry * (1 - sl / 100) else entry * (1 + sl / 100) end as sl_price from cells)""",
        """touched as (
  select * exclude (path),
    list_position(list_transform(path, lambda x: case when side = 0 then x.l <= sl_price else x.h >= sl_price end
                                   or case when side = 0 then x.h >= tp_price else x.l <= tp_price end), true) as step,
    list_transform(path, lambda x: case when side = 0 then x.l <= sl_price else x.h >= sl_price end) as stops
  from priced)""",
        """outcomes as materialized (
  select * exclude (stops), case when coalesce(step, 0) = 0 then 2 when stops[step] then 1 else 0 end as code,
    case when coalesce(step, 0) = 0 then 20 else step end as held,
    case when coalesce(step, 0) = 0 then last_close when stops[step] then sl_price else tp_price end as exit_price,
    case when coalesce(step, 0) = 0 then (case when side = 0 then 1 else -1 end) * (last_close - entry) / entry * 100
         when stops[step] then -sl else tp end as gross
  from touched)""",
    ]


EXIT_CASE = "case code when 0 then 'TP' when 1 then 'SL' when 2 then 'TIMEOUT' else 'NONE' end"
ORACLES["barrier_outcomes"] = statement(
    HOURLY + VOLATILITY + [FIXED] + outcome_ctes("next_open"),
    f"""select symbol, ts, case when side = 0 then 'LONG' else 'SHORT' end as direction_name,
      {EXIT_CASE} as exit_reason, cast(held as bigint) as bars_to_exit, {r6("tp", "take_profit_pct")},
      {r6("sl", "stop_loss_pct")}, {r6("entry", "entry_price")}, {r6("exit_price", "exit_price")},
      {r6("gross", "gross_return_pct")}, {r6(f"gross - {COST}", "net_return_pct")}
    from outcomes""",
)


def label_ctes(mode: str, sma_filter: bool, entry: str = "next_open", every: bool = False) -> list[str]:
    # free of bounds the ratio is that of the multiples, which are decimals
    allowed = """case when atr_pct * tp_m::double between 0.1 and 10.0 and atr_pct * sl_m::double between 0.05 and 5.0
        then tp_m >= 1.5 * sl_m else tp / greatest(sl, 1e-9) >= 1.5::double end and rn < n - 20"""
    if mode == "oracle_best":
        allowed += " and atr_level <= 2.0"
    if sma_filter:
        allowed += " and (case when side = 0 then close > sma20_or_close else close < sma20_or_close end)"
    if not every:
        allowed += f" and code = 0 and gross - {COST} > 0"
    return [
        GRID if mode == "oracle_best" else FIXED,
        *outcome_ctes(entry),
        f"""best as (
  select * from (select *, row_number() over (partition by symbol, rn
                          order by gross desc, tp_i, sl_i, side) as place from outcomes where {allowed})
  where place = 1)""",
        f"""labels as materialized (
  select b.*, coalesce(side, 1) as direction_label, coalesce(tp, 0) as take_profit_pct, coalesce(sl, 0) as stop_loss_pct,
    coalesce(gross - {COST}, 0) as expected_return_pct, coalesce(held, 20)::double as time_to_target,
    case when side is null then 0 when side = 0 then tp else -tp end as magnitude_label, entry as entry_price,
    exit_price, coalesce({EXIT_CASE.replace("else 'NONE'", "when 3 then 'NONE'")}, 'NONE') as exit_reason,
    coalesce(held, 0) as bars_to_exit, coalesce(gross - {COST}, 0) as trade_return_pct,
    coalesce(gross, 0) as gross_return_pct, coalesce(gross - {COST}, 0) as net_return_pct,
    case when side is null then 0 else tp / greatest(sl, 1e-9) end as rr_ratio,
    case side when 0 then 'LONG' when 2 then 'SHORT' else 'NEUTRAL' end as direction_name,
    {str(sma_filter).lower()} as sma_filter_used, '{mode}' as labeling_mode, '{entry}' as entry_mode,
    b.rn < b.n - 20 as label_valid
  from b left join (select * exclude (open, high, low, close, volume, ts, n) from best) x using (symbol, rn))""",
    ]


LABEL_DOUBLES = ["take_profit_pct", "stop_loss_pct", "expected_return_pct", "time_to_target", "magnitude_label",
                 "entry_price", "exit_price", "trade_return_pct", "gross_return_pct", "net_return_pct", "rr_ratio"]
LABEL_SELECT = f"""select symbol, ts, cast(direction_label as bigint) as direction_label, {rolled(*LABEL_DOUBLES)},
  exit_reason, cast(bars_to_exit as bigint) as bars_to_exit, direction_name, sma_filter_used, labeling_mode, entry_mode,
  label_valid from labels"""
ORACLES["best_trade_labels"] = statement(HOURLY + VOLATILITY + label_ctes("oracle_best", True), LABEL_SELECT)
ORACLES["fixed_rule_labels"] = statement(
    HOURLY + VOLATILITY + [c.replace("'close' as entry_mode", "'current_close' as entry_mode")
                           for c in label_ctes("fixed_rule", False, "close", True)], LABEL_SELECT
)
FULL = WIDE + CTX + [MA_STATUS, CONDITIONS]
BULL = ["price_above_ema5", "price_above_ema9", "price_above_ema20", "price_above_hma9"] + [
    f"condition_{n}" for n in ("ema5_above_ema20", "ema5_cross_above_ema20", "ema9_above_ema21", "hma9_above_hma21",
                               "hma9_cross_above_hma21", "trend_regime_up", "macd_bullish", "macd_hist_positive",
                               "dmp_above_dmn", "rsi_rising", "momentum_up", "roc3_positive", "roc12_positive",
                               "above_vwap", "obv_rising", "mtf_4h_trend_up", "mtf_4h_rsi_bullish")]
BEAR_FALSE = BULL[:4] + ["condition_ema5_above_ema20"]
BEAR_TRUE = [
    f"condition_{n}" for n in ("ema5_cross_below_ema20", "hma9_cross_below_hma21", "trend_regime_down", "macd_bearish",
                               "macd_hist_negative", "dmn_above_dmp", "rsi_falling", "momentum_down", "roc3_negative",
                               "roc12_negative", "below_vwap", "obv_falling", "mtf_4h_trend_down",
                               "mtf_4h_rsi_bearish")]
SCORES = f"""scored as materialized (
  select *, abs(bull - bear) as edge, case direction_label when 0 then bull when 2 then bear else 0 end as score
  from (select l.*, {" + ".join(f"{c}::int" for c in BULL)} as bull,
          {" + ".join([f"(not {c})::int" for c in BEAR_FALSE] + [f"{c}::int" for c in BEAR_TRUE])} as bear,
          price_above_ema20 and condition_mtf_4h_trend_up as bull_required,
          not price_above_ema20 and condition_mtf_4h_trend_down as bear_required
        from labels l join (select * exclude (ts) from ma) using (symbol, rn)
        join (select * exclude (ts) from cond) using (symbol, rn)))"""
CONFIRMED = """confirmed as (
  select *, case when direction_label = 1 then 'oracle_neutral' when not label_valid then 'invalid_lookahead_window'
      when net_return_pct <= 0 then 'non_positive_return' {required} when score < 8 then 'weak_confirmation'
      when edge < 3 then 'conflicting_confirmation' else 'confirmed' end as reason from scored)"""
REQUIRED = """when not (case direction_label when 0 then bull_required else bear_required end)
        then 'missing_required_trend_confirmation'"""
KEEP = "reason in ('oracle_neutral', 'confirmed')"
for name, required in {"confirmed_labels": "", "confirmed_with_required_flags": REQUIRED}.items():
    ORACLES[name] = statement(
        FULL + VOLATILITY + label_ctes("oracle_best", True) + [SCORES, CONFIRMED.format(required=required)],
        f"""select symbol, ts, cast(case when {KEEP} then direction_label else 1 end as bigint) as direction_label,
          case when {KEEP} then direction_name else 'NEUTRAL' end as direction_name,
          cast(direction_label as bigint) as oracle_direction_label, direction_name as oracle_direction_name,
          {r6("bull::double", "confirmation_bull_score")}, {r6("bear::double", "confirmation_bear_score")},
          {r6("score::double", "confirmation_score")}, {r6("edge::double", "confirmation_edge")},
          true as confirmation_filter_used, reason as label_filter_reason,
          {", ".join(r6(f"case when {KEEP} then {c} else 0 end", c) for c in LABEL_DOUBLES
                     if c not in ("time_to_target", "entry_price", "exit_price"))},
          {r6("time_to_target", "time_to_target")},
          {", ".join(r6(f"case when {KEEP} then {c} end", c) for c in ("entry_price", "exit_price"))},
          cast(case when {KEEP} then bars_to_exit else 0 end as bigint) as bars_to_exit,
          case when {KEEP} then exit_reason else 'NONE' end as exit_reason
        from confirmed""",
    )

# Label reports


def drawdown_sql(source: str, keys: str, order: str, factor: str, start: bool = False) -> str:
    """Worst fall of the running product, by plain windows over each key."""
    peak = "max(eq) over w"
    if start:
        peak = f"greatest({peak}, 1.0)"
    return f"""(select {keys}, least(min(eq / peak - 1), 0) * 100 as max_drawdown_pct
      from (select *, {peak} as peak from (
              select {keys}, {order}, product({factor}) over (partition by {keys} order by {order}) as eq from {source})
            window w as (partition by {keys} order by {order})) group by {keys})"""


def pct(a: str, b: str) -> str:
    return f"case when {b} = 0 then 0 else {a}::double / {b} * 100 end"


PF = """case when coalesce(sum(net_return_pct) filter (net_return_pct < 0), 0) = 0
      then case when coalesce(sum(net_return_pct) filter (net_return_pct > 0), 0) > 0 then 'inf'::double else 0 end
      else sum(net_return_pct) filter (net_return_pct > 0) / abs(sum(net_return_pct) filter (net_return_pct < 0)) end"""
STATS = ["trade_rate_pct", "gross_return_pct", "net_return_pct", "avg_return_per_trade", "win_rate_pct",
         "loss_rate_pct", "profit_factor", "average_win_pct", "average_loss_pct", "max_drawdown_pct",
         "avg_bars_to_exit", "median_bars_to_exit", "avg_tp_pct", "avg_sl_pct", "long_win_rate_pct",
         "short_win_rate_pct"]


def label_stats_select(source: str, keys: str) -> str:
    trade = "direction_label <> 1"
    return f"""select {keys}, total_rows, total_trades, long_trades, short_trades, neutral_count, {rolled(*STATS)}
    from (select {keys}, count(*) as total_rows, count(*) filter ({trade}) as total_trades,
        count(*) filter (direction_label = 0) as long_trades, count(*) filter (direction_label = 2) as short_trades,
        count(*) filter (direction_label = 1) as neutral_count,
        {pct(f"count(*) filter ({trade})", "count(*)")} as trade_rate_pct,
        {pct(f"count(*) filter ({trade} and net_return_pct > 0)", f"count(*) filter ({trade})")} as win_rate_pct,
        {pct(f"count(*) filter ({trade} and net_return_pct < 0)", f"count(*) filter ({trade})")} as loss_rate_pct,
        {pct("count(*) filter (direction_label = 0 and net_return_pct > 0)", "count(*) filter (direction_label = 0)")}
          as long_win_rate_pct,
        {pct("count(*) filter (direction_label = 2 and net_return_pct > 0)", "count(*) filter (direction_label = 2)")}
          as short_win_rate_pct
      from {source} group by {keys})
    left join (select {keys}, sum(gross_return_pct) as gross_return_pct, sum(net_return_pct) as net_return_pct,
        avg(net_return_pct) as avg_return_per_trade, {PF} as profit_factor,
        coalesce(avg(net_return_pct) filter (net_return_pct > 0), 0) as average_win_pct,
        coalesce(avg(net_return_pct) filter (net_return_pct < 0), 0) as average_loss_pct,
        avg(bars_to_exit) as avg_bars_to_exit, median(bars_to_exit) as median_bars_to_exit,
        avg(take_profit_pct) as avg_tp_pct, avg(stop_loss_pct) as avg_sl_pct
      from {source} where {trade} group by {keys}) using ({keys})
    left join {drawdown_sql(f"(select * from {source} where {trade})", keys, "rn", "1 + net_return_pct / 100")}
      using ({keys})"""


ORACLES["label_statistics"] = statement(
    HOURLY + VOLATILITY + label_ctes("fixed_rule", False, every=True), label_stats_select("labels", "symbol")
)
_with = [c.replace("labels as", "labels_b as", 1).replace("from best)", "from best_b)").replace("best as", "best_b as", 1)
         for c in label_ctes("fixed_rule", True)[-2:]]
ORACLES["sma_filter_comparison"] = statement(
    HOURLY + VOLATILITY + label_ctes("fixed_rule", False) + _with
    + ["both_ways as materialized (select *, 'without_sma20' as scenario from labels union all "
       "select *, 'with_sma20' from labels_b)"],
    label_stats_select("both_ways", "symbol, scenario"),
)
ORACLES["label_quality"] = statement(
    HOURLY + VOLATILITY + label_ctes("oracle_best", True),
    f"""select symbol, count(*) as total_rows, count(*) filter (direction_label = 0) as long_count,
      count(*) filter (direction_label = 1) as neutral_count, count(*) filter (direction_label = 2) as short_count,
      {", ".join(r6(pct(f"count(*) filter (direction_label = {k})", "count(*)"), f"{n}_pct")
                 for k, n in enumerate(("long", "neutral", "short")))},
      {", ".join(r6(f"coalesce(avg({c}) filter (direction_label <> 1), 0)", n) for c, n in (
          ("take_profit_pct", "avg_tp_pct"), ("stop_loss_pct", "avg_sl_pct"), ("net_return_pct", "avg_return_pct"),
          ("bars_to_exit", "avg_time_to_target")))},
      count(*) filter (exit_reason = 'TIMEOUT') as timeout_trades, count(*) filter (exit_reason = 'SL') as sl_hits,
      count(*) filter (exit_reason = 'TP') as tp_hits
    from labels group by symbol""",
)

STATE_DOUBLES = ["trade_pct_of_direction", "profitable_trade_pct_of_direction", "win_rate_pct", "loss_rate_pct",
                 "gross_return_pct", "net_return_pct", "avg_return_per_trade", "profit_factor", "average_win_pct",
                 "average_loss_pct", "max_drawdown_pct", "avg_bars_to_exit"]


def state_ctes(state: str, listed: str) -> list[str]:
    """`state`: rows (symbol, rn, state columns) a trade was in; `listed`: all states."""
    names = "moving_average, relationship" if "relationship" in listed else "condition"
    return [
        """deals as materialized (
  select symbol, rn, case direction_label when 0 then 'BUY' else 'SELL' end as direction, net_return_pct,
    gross_return_pct, bars_to_exit from labels where direction_label <> 1)""",
        f"held as materialized (select * from deals join ({state}) using (symbol, rn))",
        f"""report as materialized (
  select symbol, direction, {names}, coalesce(k, 0) as total_trades, coalesce(w, 0) as profitable_trades,
    {pct("coalesce(k, 0)", "of_direction")} as trade_pct_of_direction,
    {pct("coalesce(w, 0)", "profitable")} as profitable_trade_pct_of_direction,
    {pct("coalesce(w, 0)", "coalesce(k, 0)")} as win_rate_pct, {pct("coalesce(lo, 0)", "coalesce(k, 0)")} as loss_rate_pct,
    {", ".join(f"coalesce({c}, 0) as {c}" for c in STATE_DOUBLES[4:])}
  from (select symbol, direction, count(d.rn) as of_direction, count(d.rn) filter (net_return_pct > 0) as profitable
        from (select distinct symbol from b) cross join (values ('BUY'), ('SELL')) v(direction)
        left join deals d using (symbol, direction) group by symbol, direction)
  cross join ({listed})
  left join (select symbol, direction, {names}, count(*) as k, count(*) filter (net_return_pct > 0) as w,
      count(*) filter (net_return_pct < 0) as lo, sum(gross_return_pct) as gross_return_pct,
      sum(net_return_pct) as net_return_pct, avg(net_return_pct) as avg_return_per_trade, {PF} as profit_factor,
      avg(net_return_pct) filter (net_return_pct > 0) as average_win_pct,
      avg(net_return_pct) filter (net_return_pct < 0) as average_loss_pct, avg(bars_to_exit) as avg_bars_to_exit
    from held group by all) using (symbol, direction, {names})
  left join {drawdown_sql("held", f"symbol, direction, {names}", "rn", "1 + net_return_pct / 100")}
    using (symbol, direction, {names}))""",
    ]


MA_STATES = state_ctes(
    " union all ".join(
        f"select symbol, rn, '{m}' as moving_average, case when price_above_{m} then 'above' else 'below' end "
        "as relationship from ma" for m in AVERAGES
    ),
    "select * from (values " + ", ".join(f"('{m}')" for m in AVERAGES)
    + ") x(moving_average) cross join (values ('above'), ('below')) y(relationship)",
)
MA_REPORT = f"""select symbol, direction, moving_average, relationship,
  concat('price_', relationship, '_', moving_average) as condition,
  (relationship = 'above') = (direction = 'BUY') as is_expected_trend_side, total_trades, profitable_trades,
  {rolled(*STATE_DOUBLES)} from report"""
MA_BASE = HOURLY + SMOOTH + HULL + [MA_STATUS] + VOLATILITY
ORACLES["moving_average_report"] = statement(
    MA_BASE + label_ctes("fixed_rule", False, every=True) + MA_STATES, MA_REPORT
)
ORACLES["best_moving_average_conditions"] = statement(
    MA_BASE + label_ctes("oracle_best", True) + MA_STATES, MA_REPORT + " where total_trades >= 25"
)
CONDITION_STATES = state_ctes(
    " union all ".join(
        f"select symbol, rn, 'condition_{n}' as condition from cond where condition_{n}" for n in FLAGS
    ),
    "select * from (values " + ", ".join(f"('condition_{n}')" for n in FLAGS) + ") x(condition)",
)
CONDITION_REPORT = f"""select symbol, direction, condition, total_trades, profitable_trades, {rolled(*STATE_DOUBLES)}
  from report"""
COND_BASE = WIDE + CTX + [CONDITIONS] + VOLATILITY
ORACLES["technical_condition_report"] = statement(
    COND_BASE + label_ctes("fixed_rule", False, every=True) + CONDITION_STATES, CONDITION_REPORT
)
ORACLES["best_technical_conditions"] = statement(
    COND_BASE + label_ctes("oracle_best", True) + CONDITION_STATES, CONDITION_REPORT + " where total_trades >= 25"
)

# Predictions and their evaluation

PREDICTED = f"""pr as materialized (
  select lab.* exclude (n, upside_max_return, downside_max_return, max_return, horizon_label_valid), lab.n - 20 as n,
    round(1 / (1 + exp(-0.4 * round(roc_6, 6))), 6) as p_up, round(least(5.0, 2 * round(natr, 5)), 6) as up_pred,
    round(least(5.0, 1.5 * round(natr, 5)), 6) as dn_pred
  from lab join (select symbol, rn, roc_6, natr from ft) using (symbol, rn) where horizon_label_valid)"""
EVALUATED = """er as materialized (
  select *, p_up >= 0.5 as pred_up, y_up >= y_dn as actual_up, (p_up >= 0.5) = (y_up >= y_dn) as correct,
    greatest(p_up, 1 - p_up) as confidence, case when p_up >= 0.5 then up_pred else dn_pred end as pred_mag,
    (case when p_up >= 0.5 then y_up else y_dn end)::double as achieved_mag from pr)"""
PRED = HOURLY + [LABELED] + model_feature_ctes() + [PREDICTED]
EVAL = PRED + [EVALUATED]
ORACLES["prediction_rows"] = statement(
    EVAL, f"select symbol, ts, pred_up, actual_up, correct, {rolled('confidence', 'pred_mag', 'achieved_mag')} from er"
)
ORACLES["direction_scorecard"] = statement(
    EVAL,
    f"""select symbol, count(*) as n_total, {r6("avg(correct::int)", "accuracy")},
      {r6("avg(actual_up::int)", "base_rate_up")}, count(*) filter (pred_up) as n_pred_up,
      count(*) filter (pred_up and actual_up) as n_pred_up_correct, count(*) filter (not pred_up) as n_pred_down,
      count(*) filter (not pred_up and not actual_up) as n_pred_down_correct,
      {r6("avg(abs(up_pred - y_up::double))", "mae_up")}, {r6("avg(abs(dn_pred - y_dn::double))", "mae_down")},
      {r6("count(*) filter (pred_up and actual_up) / nullif(count(*) filter (pred_up), 0)", "up_accuracy")},
      {r6("count(*) filter (not pred_up and not actual_up) / nullif(count(*) filter (not pred_up), 0)", "down_accuracy")},
      {r6("greatest(avg(actual_up::int), 1 - avg(actual_up::int))", "best_constant")}
    from er group by symbol""",
)
ORACLES["split_scorecards"] = ORACLES["direction_scorecard"].replace(
    ",\n".join([EVALUATED]), ",\n".join([SPLIT, EVALUATED])
).replace("select symbol, count(*) as n_total", "select symbol, split, count(*) as n_total").replace(
    "from er group by symbol",
    "from er join (select symbol, rn, split from sp) using (symbol, rn) where split in ('val', 'test') group by symbol, split",
)
ORACLES["confidence_buckets"] = statement(
    EVAL,
    f"""select symbol, {r6("lo", "lo")}, {r6("hi", "hi")}, count(confidence) as n,
      {r6("count(confidence) / any_value(total)::double", "share")}, {r6("avg(correct::int)", "accuracy")}
    from (select symbol, count(*) as total from er group by symbol)
    cross join (values (0.50::double, 0.55::double), (0.55::double, 0.60::double), (0.60::double, 0.65::double),
                       (0.65::double, 1.01::double)) e(lo, hi)
    left join er using (symbol) where confidence is null or true
    group by symbol, lo, hi""".replace(
        "left join er using (symbol) where confidence is null or true",
        "left join er on er.symbol = s.symbol and confidence >= lo and confidence < hi",
    ).replace("from er group by symbol)", "from er group by symbol) s").replace("select symbol, round", "select s.symbol, round")
    .replace("group by symbol, lo, hi", "group by s.symbol, lo, hi"),
)
ORACLES["probability_calibration"] = statement(
    EVAL,
    f"""select symbol, bucket, {r6("bucket / 10.0::double", "lo")}, {r6("(bucket + 1) / 10.0::double", "hi")},
      count(*) as n, {r6("avg(p_up)", "mean_p_up")}, {r6("avg(actual_up::int)", "actual_up_rate")}
    from (select *, case {" ".join(f"when p_up < {(k + 1) * 0.1!r}::double then {k}" for k in range(9))} else 9 end::bigint
            as bucket from er)
    group by symbol, bucket having count(*) >= 20""",
)
ORACLES["magnitude_buckets"] = statement(
    EVAL,
    f"""select s.symbol, {r6("lo", "lo")}, {r6("hi", "hi")}, count(pred_mag) as n, {r6("avg(pred_mag)", "mean_predicted")},
      {r6("avg(achieved_mag)", "mean_achieved")}, {r6("median(achieved_mag)", "median_achieved")},
      {r6("avg((achieved_mag >= pred_mag)::int)", "hit_full")},
      {r6("avg((achieved_mag >= 0.8::double * pred_mag)::int)", "hit_80")}
    from (select distinct symbol from er) s
    cross join (values (0::double, 0.5::double), (0.5::double, 1::double), (1::double, 1.5::double),
                       (1.5::double, 'inf'::double)) e(lo, hi)
    left join er on er.symbol = s.symbol and pred_mag >= lo and pred_mag < hi
    group by s.symbol, lo, hi""",
)
ORACLES["achieved_move_histogram"] = statement(
    EVAL,
    f"""select s.symbol, c.correct, g.bin, count(e.ts) as n, {r6("g.bin * any_value(p99) / 49", "lo")},
      {r6("count(e.ts) / (nullif(sum(count(e.ts)) over (partition by s.symbol, c.correct), 0) * any_value(p99) / 49)",
          "density")},
      {r6("any_value(greatest(p99, top)) * 1.05", "axis_limit")}
    from (select symbol, quantile_cont(achieved_mag, 0.99) as p99, max(pred_mag) as top from er group by symbol) s
    cross join (values (true), (false)) c(correct) cross join (select unnest(range(49)) as bin) g
    left join er e on e.symbol = s.symbol and e.correct = c.correct and e.achieved_mag <= p99
      and g.bin = least(cast(floor(e.achieved_mag / (p99 / 49)) as bigint), 48)
    group by s.symbol, c.correct, g.bin""",
)
ORACLES["validation_metrics"] = statement(
    PRED
    + [
        """lo as (
      select *, (ln(1 + exp(logit)) - logit * y_dir) * (1 + least(abs(y_up::double - y_dn::double), 3)) as loss_dir,
        (case when abs(up_pred - y_up::double) <= 1.5 then (up_pred - y_up::double) ** 2 / 2
              else 1.5 * (abs(up_pred - y_up::double) - 0.75) end) * (1 + y_up::double) as loss_up,
        (case when abs(dn_pred - y_dn::double) <= 1.5 then (dn_pred - y_dn::double) ** 2 / 2
              else 1.5 * (abs(dn_pred - y_dn::double) - 0.75) end) * (1 + y_dn::double) as loss_dn
      from (select *, ln(p_up / (1 - p_up)) as logit from pr))"""
    ],
    f"""select symbol, count(*) as n, {r6("avg(loss_dir)", "loss_dir")}, {r6("avg(loss_up)", "loss_up")},
      {r6("avg(loss_dn)", "loss_dn")}, {r6("avg(loss_dir + 0.5 * (loss_up + loss_dn))", "loss")},
      {r6("avg(((logit >= 0) = (y_dir >= 0.5))::int)", "direction_accuracy")},
      {r6("avg(abs(up_pred - y_up::double) + abs(dn_pred - y_dn::double)) / 2", "magnitude_mae")}
    from lo group by symbol""",
)

# Trades

SCENARIOS = """sc(scenario, min_conf, min_move, tpf, slf, cost, frac, capital, ruin, hold) as (values
  ('base', 0.6::double, 0.6::double, 0.8::double, 0.5::double, 0.0014::double, 0.95::double, 100.0::double, 1.0::double, 20),
  ('bold', 0.5::double, 0.3::double, 1.0::double, 0.8::double, 0.0014::double, 0.95::double, 100.0::double, 1.0::double, 20),
  ('short_hold', 0.6::double, 0.6::double, 0.8::double, 0.5::double, 0.0014::double, 0.5::double, 100.0::double, 1.0::double, 5),
  ('ruin', 0.5::double, 0.1::double, 0.8::double, 0.5::double, 0.1204::double, 0.95::double, 100.0::double, 40.0::double, 20),
  ('idle', 1.5::double, 0.6::double, 0.8::double, 0.5::double, 0.0014::double, 0.95::double, 100.0::double, 1.0::double, 20))"""
CANDIDATES = [
    SCENARIOS,
    """paths as materialized (
  select *, greatest(p_up, 1 - p_up) as confidence, p_up >= 0.5 as is_long,
    case when p_up >= 0.5 then up_pred else dn_pred end as pred_move, lead(open) over (partition by symbol order by ts) as entry,
    list({'h': high, 'l': low, 'c': close, 'ts': ts})
      over (partition by symbol order by ts rows between 1 following and 20 following) as path from pr)""",
    """aimed as materialized (
  select *, list_slice(path, 1, hold) as held,
    entry * (case when is_long then 1 + pred_move * tpf / 100 else 1 - pred_move * tpf / 100 end) as tp_price,
    entry * (case when is_long then 1 - pred_move * slf / 100 else 1 + pred_move * slf / 100 end) as sl_price
  from paths, sc where confidence >= min_conf and pred_move >= min_move and entry is not null)""",
    """touching as (
  select *, list_transform(held, lambda x: case when is_long then x.l <= sl_price else x.h >= sl_price end) as stops,
    list_transform(held, lambda x: case when is_long then x.l <= sl_price else x.h >= sl_price end
                                or case when is_long then x.h >= tp_price else x.l <= tp_price end) as touches
  from aimed)""",
    """cand as materialized (
  select symbol, scenario, rn, rn + hold_bars as exit_rn, held[1].ts as entry_time, held[hold_bars].ts as exit_time,
    case when is_long then 'LONG' else 'SHORT' end as side, confidence, pred_move,
    (case when is_long then y_up else y_dn end)::double as achieved, is_long = (y_up >= y_dn) as dir_correct,
    exit_reason, cast(hold_bars as bigint) as hold_bars, frac, capital, ruin,
    (xp - entry) / entry * (case when is_long then 1 else -1 end) as raw,
    (xp - entry) / entry * (case when is_long then 1 else -1 end) - cost as net
  from (select *, case when step is null then 'TIME' when stops[step] then 'SL' else 'TP' end as exit_reason,
          coalesce(step, len(held)) as hold_bars,
          case when step is null then held[len(held)].c when stops[step] then sl_price else tp_price end as xp
        from (select *, nullif(list_position(touches, true), 0) as step from touching)))""",
]
ORACLES["candidate_trades"] = statement(
    PRED + CANDIDATES,
    f"""select symbol, scenario, rn, exit_rn, entry_time, exit_time, side, {rolled("confidence", "pred_move", "achieved")},
      dir_correct, exit_reason, hold_bars from cand""",
)
CHOSEN = [
    """pointers as materialized (
  select c.symbol, c.scenario, c.rn, d.rn as next_rn from cand c asof left join cand d
    on c.symbol = d.symbol and c.scenario = d.scenario and d.rn > c.exit_rn)""",
    """chain as (
  select symbol, scenario, min(rn) as rn from cand group by symbol, scenario
  union all
  select c.symbol, c.scenario, p.next_rn from chain c join pointers p using (symbol, scenario, rn)
  where p.next_rn is not null)""",
    """grown as materialized (
  select *, capital * product(1 + frac * net) over (partition by symbol, scenario order by rn) as equity
  from cand join chain using (symbol, scenario, rn))""",
    """tr as materialized (
  select *, raw * 100 as raw_ret_pct, net * 100 as net_ret_pct, equity - equity / (1 + frac * net) as pnl_usd
  from (select *, coalesce(max((equity <= ruin)::int) over (partition by symbol, scenario order by rn
                    rows between unbounded preceding and 1 preceding), 0) as over_before from grown)
  where over_before = 0)""",
]
DEALS = PRED + CANDIDATES + CHOSEN
LEDGER_SELECT = f"""select symbol, scenario, entry_time, exit_time, side, dir_correct, exit_reason, hold_bars,
  {rolled("confidence", "pred_move", "achieved", "raw_ret_pct", "net_ret_pct", "pnl_usd", "equity")}"""
ORACLES["trade_ledger"] = statement(DEALS, LEDGER_SELECT + " from tr")
ORACLES["last_ten_trades"] = statement(
    DEALS,
    LEDGER_SELECT + " from (select *, row_number() over (partition by symbol, scenario order by rn desc) as nr from tr)"
    " where nr <= 10",
)
ORACLES["equity_curve"] = statement(
    DEALS,
    f"""select symbol, scenario, trade_no, {rolled("equity", "peak")}, {r6("(equity - peak) / peak", "drawdown")}
    from (select symbol, scenario, row_number() over w as trade_no, equity, greatest(max(equity) over w, capital) as peak
          from tr window w as (partition by symbol, scenario order by rn)
          union all select symbol, scenario, 0, capital, capital from (select distinct symbol from pr), sc)""",
)
SUMMARY = f"""summ as materialized (
  select symbol, scenario, start_capital, final_capital, (final_capital / start_capital - 1) * 100 as total_return_pct,
    (c1 / c0 - 1) * 100 as buy_hold_pct, coalesce(max_drawdown_pct, 0) as max_drawdown_pct, trades, days,
    trades / days as trades_per_day
  from (select s.symbol, sc.scenario, any_value(sc.capital) as start_capital,
          coalesce(arg_max(tr.equity, tr.rn), any_value(sc.capital)) as final_capital, count(tr.rn) as trades
        from (select distinct symbol from pr) s cross join sc
        left join tr on tr.symbol = s.symbol and tr.scenario = sc.scenario group by 1, 2)
  join (select symbol, arg_min(close, ts) as c0, arg_max(close, ts) as c1,
          greatest((epoch(max(ts)) - epoch(min(ts))) / 86400, 1) as days from pr group by 1) using (symbol)
  left join {drawdown_sql("tr", "symbol, scenario", "rn", "1 + frac * net", True)} using (symbol, scenario))"""
ORACLES["capital_summary"] = statement(
    DEALS + [SUMMARY],
    f"""select symbol, scenario, trades, {rolled("start_capital", "final_capital", "total_return_pct", "buy_hold_pct",
        "max_drawdown_pct", "days", "trades_per_day")} from summ""",
)
ORACLES["trade_statistics"] = statement(
    DEALS + [SUMMARY],
    f"""select symbol, scenario, trades, wins, trades - wins as losses, {r6("wins / trades * 100", "win_rate_pct")},
      {rolled("avg_win_pct", "avg_loss_pct", "expectancy_pct", "profit_factor", "sharpe", "avg_hold_bars")}
    from (select symbol, scenario, count(*) as trades, count(*) filter (pnl_usd > 0) as wins,
        avg(net_ret_pct) filter (pnl_usd > 0) as avg_win_pct, avg(net_ret_pct) filter (pnl_usd <= 0) as avg_loss_pct,
        avg(net_ret_pct) as expectancy_pct,
        case when coalesce(abs(sum(pnl_usd) filter (pnl_usd <= 0)), 0) > 0
             then coalesce(sum(pnl_usd) filter (pnl_usd > 0), 0) / abs(sum(pnl_usd) filter (pnl_usd <= 0))
             else 'inf'::double end as profit_factor,
        case when stddev_pop(net_ret_pct) > 0 then avg(net_ret_pct) / stddev_pop(net_ret_pct)
             * sqrt(count(*) / any_value(days) * 365) else 0 end as sharpe,
        avg(hold_bars) as avg_hold_bars
      from tr join (select symbol, scenario, days from summ) using (symbol, scenario) group by 1, 2)""",
)
ORACLES["exit_breakdown"] = statement(
    DEALS,
    f"""select s.symbol, s.scenario, e.exit_reason, count(rn) as trades,
      {r6("avg((pnl_usd > 0)::int) * 100", "win_rate_pct")}, {r6("avg(net_ret_pct)", "avg_net_pct")}
    from (select distinct symbol, scenario from tr) s cross join (values ('TP'), ('SL'), ('TIME')) e(exit_reason)
    left join tr on tr.symbol = s.symbol and tr.scenario = s.scenario and tr.exit_reason = e.exit_reason
    group by 1, 2, 3""",
)
ORACLES["direction_on_trades"] = statement(
    DEALS,
    f"""select s.symbol, s.scenario, e.side, count(rn) as trades,
      {r6("avg(dir_correct::int) * 100", "direction_accuracy_pct")}, {r6("avg(pred_move)", "avg_predicted")},
      {r6("median(achieved)", "median_achieved")}
    from (select distinct symbol, scenario from tr) s cross join (values ('LONG'), ('SHORT'), ('ALL')) e(side)
    left join tr on tr.symbol = s.symbol and tr.scenario = s.scenario and (tr.side = e.side or e.side = 'ALL')
    group by 1, 2, 3""",
)
ORACLES["monthly_results"] = statement(
    DEALS,
    f"""select symbol, scenario, strftime(exit_time, '%Y-%m') as month, count(*) as trades,
      {r6("avg((pnl_usd > 0)::int) * 100", "win_rate_pct")}, {r6("(product(1 + frac * net) - 1) * 100", "return_pct")},
      {r6("arg_max(equity, rn)", "equity_end")}
    from tr group by 1, 2, 3""",
)
ORACLES["pnl_histogram"] = statement(
    DEALS,
    f"""select s.symbol, s.scenario, g.bin, {r6("any_value(s.lo + g.bin * (s.hi - s.lo) / 39)", "lo")},
      count(*) filter (d.net_ret_pct > 0) as wins, count(*) filter (d.net_ret_pct <= 0) as losses
    from (select symbol, scenario, min(net_ret_pct) as lo, max(net_ret_pct) as hi from tr group by 1, 2) s
    cross join (select unnest(range(39)) as bin) g
    left join tr d on d.symbol = s.symbol and d.scenario = s.scenario and g.bin = case when s.hi = s.lo then 0
      else least(cast(floor((d.net_ret_pct - s.lo) / ((s.hi - s.lo) / 39)) as bigint), 38) end
    group by 1, 2, 3""",
)

# Single series operators

ORACLES["rolling_statistics"] = statement(
    HOURLY,
    "select symbol, ts, "
    + ", ".join(
        r6(roll(fn, "close", n), f"{kind}_{n}")
        for kind, fn in (("mean", "avg"), ("sum", "sum"), ("min", "min"), ("max", "max"), ("std", "stddev_samp"))
        for n in (5, 50)
    )
    + ", " + r6(f"avg(volume) {frame(20)}", "mean_20_from_1") + " from b",
)
ORACLES["lagged_changes"] = statement(
    HOURLY,
    "select symbol, ts, "
    + ", ".join(
        f"{r6(f'close - {lag('close', k)}', f'diff_{k}')}, {r6(f'close / {lag('close', k)} - 1', f'pct_change_{k}')}, "
        f"{r6(f'ln(close / {lag('close', k)})', f'log_return_{k}')}"
        for k in (1, 3, 12, 24)
    )
    + " from b",
)
ORACLES["smoothed_means"] = statement(
    HOURLY
    + ewm("e", "b", {f"ema_{n}": ("close", span(n), n) for n in (5, 21, 200)}
          | {"wilder_volume_14": ("volume", 1.0 / 14, 14)}),
    f"select symbol, ts, {rolled('ema_5', 'ema_21', 'ema_200', 'wilder_volume_14')} from b join e using (symbol, rn)",
)
ORACLES["weighted_means"] = statement(
    HOURLY
    + [f"""w1 as materialized (select symbol, ts, {", ".join(f"{wma('close', n)} as wma{n}" for n in (4, 10, 25))},
      {", ".join(f"2 * {wma('close', h)} - {wma('close', n)} as raw{n}" for n, h in ((9, 4), (21, 10), (50, 25)))} from b)"""],
    f"select symbol, ts, {rolled('wma4', 'wma10', 'wma25')}, "
    + ", ".join(r6(wma(f"raw{n}", s), f"hull{n}") for n, s in ((9, 3), (21, 4), (50, 7))) + " from w1",
)
ORACLES["rolling_percent_rank"] = statement(
    HOURLY,
    f"""select symbol, ts, {r6("case when rn >= 99 then (len(list_filter(l, lambda x: x < volume)) + (len(list_filter(l, lambda x: x = volume)) + 1) / 2.0) / 100 end", "volume_rank")}
    from (select *, list(volume) {frame(100)} as l from b)""",
)
ORACLES["on_balance_volume"] = statement(
    HOURLY,
    f"""select symbol, ts, {r6("sv", "signed_volume")}, {r6(f"sum(sv) {W}", "obv")}
    from (select *, coalesce(sign(close - {lag("close", 1)}), 0) * volume as sv from b)""",
)
ORACLES["forward_filled_gaps"] = statement(
    HOURLY,
    f"""select symbol, ts,
      {r6(f"coalesce(last_value(case when extract('hour' from ts) % 6 = 0 then close end ignore nulls) {frame(10**9)}, 0)", "sparse")}
    from b""",
)
ORACLES["price_crossings"] = statement(
    HOURLY + ewm("e", "b", {"ema": ("close", 0.2, 9)}),
    f"""select symbol, ts, coalesce(close > ema and pc <= pe, false) as crossed_above,
      coalesce(close < ema and pc >= pe, false) as crossed_below
    from (select *, {lag("close", 1)} as pc, {lag("ema", 1)} as pe from b join e using (symbol, rn))""",
)
ORACLES["basic_indicators"] = statement(
    HOURLY
    + [MOVES, *ewm("e1", "mv", smoothing((12, 26), (14,))), dmi_cte("dm", "e1"),
       "ml as materialized (select *, ema12 - ema26 as line from dm)",
       *ewm("e2", "ml", {"macd_signal": ("line", span(9), 9), "adx": ("dx", 1.0 / 14, 14)})],
    f"""select symbol, ts, {r6("tr", "true_range")}, {r6("atr", "atr")}, {r6("coalesce(atr / close * 100, 0)", "atr_pct")},
      {r6(rsi_sql(14), "rsi")}, {r6("dmp", "plus_di")}, {r6("dmn", "minus_di")}, {r6("adx", "adx")}, {r6("line", "macd")},
      {rolled("macd_signal")}, {r6("line - macd_signal", "macd_hist")}, {r6("mid", "bb_mid")},
      {r6("mid + 2 * sd", "bb_upper")}, {r6("mid - 2 * sd", "bb_lower")},
      {r6("pv / (vv + 1e-9)", "vwap")}
    from (select *, {roll("avg", "close", 20)} as mid, {roll("stddev_samp", "close", 20)} as sd,
            {roll("sum", "(high + low + close) / 3 * volume", 20)} as pv, {roll("sum", "volume", 20)} as vv from mv)
    join ml using (symbol, rn) join e2 using (symbol, rn)""",
)
ORACLES["external_model_scores"] = statement(
    HOURLY + model_feature_ctes(),
    f"""select symbol, ts, {rolled("p_up", "up_pred", "dn_pred")}, {r6("greatest(p_up, 1 - p_up)", "confidence")},
      {r6("case when p_up >= 0.5 then up_pred else dn_pred end", "magnitude")}
    from (select symbol, ts, 1 / (1 + exp(-0.4 * roc_6)) as p_up, least(greatest(2 * natr, 0), 5) as up_pred,
            least(greatest(1.5 * natr, 0), 5) as dn_pred from ft)""",
)
ORACLES["json_export"] = statement(
    HOURLY + VOLATILITY + label_ctes("oracle_best", True)
    + [f"ls as ({label_stats_select('labels', 'symbol')})"],
    """select symbol, total_rows, total_trades, case when isfinite(profit_factor) then profit_factor end as profit_factor,
      win_rate_pct from ls""",
)
ORACLES["candle_json_records"] = statement(
    HOURLY,
    """select '{"symbol":"' || symbol || '","ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","traded":'
      || (volume > 0) || '}' as record from bars""",
)

# Streams

ORACLES["streamed_value_bars"] = f"""
select event_type as symbol, time_bucket(interval 6 hours, events.ts) as ts, {r6("arg_min(value, (events.ts, event_id))", "open")},
  {r6("max(value)", "high")}, {r6("min(value)", "low")}, {r6("arg_max(value, (events.ts, event_id))", "close")},
  {r6("sum(value)", "volume")}
from events group by event_type, time_bucket(interval 6 hours, events.ts)"""
ORACLES["streamed_first_candles"] = """
select event_type as symbol, count(distinct date_trunc('hour', ts)) as candles, min(date_trunc('hour', ts))::timestamp as first_ts
from events group by 1"""
ORACLES["streamed_indicators"] = statement(
    HOURLY + [MOVES, *ewm("e", "mv", {"ema": ("close", span(21), 21), "atr": ("tr", 1.0 / 14, 14),
                                      "g": ("gain", 1.0 / 14, 14), "l": ("loss", 1.0 / 14, 14)})],
    f"""select symbol, ts, {rolled("close", "ema", "atr")}, {r6("100 - 100 / (1 + g / (l + 1e-9))", "rsi")}
    from b join e using (symbol, rn)""",
)
ORACLES["streamed_indicators_with_late_bars"] = ORACLES["streamed_indicators"]
ORACLES["streamed_context_with_late_bars"] = ORACLES["higher_timeframe_context"]
ORACLES["streamed_context"] = ORACLES["higher_timeframe_context"]

_LEFT_OUT = {*AVERAGES, "ema21", "vwap", "vol_percentile_100", "dist_ema_5", "dist_ema_9", "dist_ema_20", "dist_ema_50",
             "dist_hma_9", "dist_hma_21"}
INPUTS = [f"tf.{c}" for c in TECHNICAL_COLUMNS if c not in _LEFT_OUT] + [
    f"ma.{c}" for c in MA_DOUBLES if c.startswith("dist_") or "_vs_" in c
]
ORACLES["model_input_columns"] = statement(
    WIDE + [MA_STATUS],
    f"""select symbol, count(*) as bars, cast(sum({" + ".join(f"({c} is not null)::int" for c in INPUTS)}) as bigint) as present,
      cast({len(INPUTS)} as bigint) as columns from tf join ma using (symbol, rn) group by symbol""",
)

# Sections of the evaluation that went through JSON, which has no infinite bound
ORACLES["exported_scorecard"] = ORACLES["direction_scorecard"]
ORACLES["exported_calibration"] = ORACLES["probability_calibration"]
ORACLES["exported_magnitude_buckets"] = (
    f"select * replace (case when isfinite(hi) then hi end as hi) from ({ORACLES['magnitude_buckets']})"
)
ORACLES["slow_means"] = statement(
    HOURLY + ewm("e", "b", {"mean_1e6": ("close", 1e-6, 1), "mean_1e9": ("volume", 1e-9, 5), "mean_fast": ("close", 0.97, 3)}),
    f"select symbol, ts, {rolled('mean_1e6', 'mean_1e9', 'mean_fast')} from b join e using (symbol, rn)",
)

# As-of joins

NEAR = "s.ts >= p.ts - interval 2 days"
ORACLES["last_view_before_purchase"] = f"""
with p as (select user_id, ts, event_id, value from events where event_type = 'purchase'),
s as (select user_id, ts, max(event_id) as event_id, max_by(value, event_id) as value from events
      where event_type = 'view' group by user_id, ts)
select p.user_id, p.ts, p.event_id, {r6("p.value", "value")}, case when {NEAR} then s.ts end as view_ts,
  case when {NEAR} then s.event_id end as view_event_id, {r6(f"case when {NEAR} then s.value end", "view_value")}
from p asof left join s on p.user_id = s.user_id and p.ts >= s.ts"""
ORACLES["previous_order_of_customer"] = f"""
with d as (select o_custkey, o_orderdate, max(o_orderkey) as k, max_by(o_totalprice, o_orderkey) as price
           from orders group by o_custkey, o_orderdate)
select o.o_custkey, o.o_orderdate, o.o_orderkey, {r6("o.o_totalprice", "o_totalprice")}, d.o_orderdate as last_o_orderdate,
  d.k as last_o_orderkey, {r6("d.price", "last_o_totalprice")}
from orders o asof join d on o.o_custkey = d.o_custkey and o.o_orderdate > d.o_orderdate"""

# Payload files

ORACLES["payload_folder_bars"] = statement(
    HOURLY, f"select symbol, ts, {ROUNDED_BARS} from bars where ts >= timestamp '2024-01-09 06:00:00' and ts < timestamp '2024-01-24'"
)
ORACLES["streamed_payload_bars"] = statement(HOURLY, f"select symbol, ts, {ROUNDED_BARS} from bars where symbol in ('click', 'view')")
LOCAL = "zoned as materialized (select * replace (ts + interval '5 hours 30 minutes' as ts) from bars)"
ORACLES["half_hour_zone_bars"] = statement(
    HOURLY + [LOCAL, resampled("h4", 14400).replace("from bars", "from zoned")], f"select symbol, ts, {ROUNDED_BARS} from h4"
)

# Full tables: every group joined

_CONTEXT_COLUMNS = [f"mtf_{t}_{c}" for t in ("4h", "1d") for c in CONTEXT]
_OWN = [c for c in TECHNICAL_COLUMNS if c not in MA_DOUBLES]
_EVERY = [*MA_DOUBLES, *_OWN, *STRUCTURE_COLUMNS, *_CONTEXT_COLUMNS]
_BOOLEANS = [f"price_above_{m}" for m in AVERAGES] + [f"condition_{n}" for n in FLAGS]
_JOINED = f"""whole as materialized (
  select b.symbol, b.ts, b.rn, {", ".join(f"ma.{c}" for c in MA_DOUBLES)}, {", ".join(f"tf.{c}" for c in _OWN)},
    {", ".join(f"ms.{c}" for c in STRUCTURE_COLUMNS)}, h4_ctx.* exclude (symbol, rn), d1_ctx.* exclude (symbol, rn),
    {", ".join(_BOOLEANS)}
  from b join ma using (symbol, rn) join tf using (symbol, rn) join ms using (symbol, rn) join cond using (symbol, rn)
    join h4_ctx using (symbol, rn) join d1_ctx using (symbol, rn))"""
ORACLES["filled_table"] = statement(
    FULL + [SWINGS, STRUCTURE, _JOINED],
    f"select symbol, ts, {', '.join(_BOOLEANS)}, "
    + ", ".join(r6(f"coalesce(last_value({c} ignore nulls) {frame(10**9)}, 0)", c) for c in _EVERY)
    + " from whole",
)
ORACLES["labeled_table"] = statement(
    FULL + [SWINGS, STRUCTURE, _JOINED] + VOLATILITY + label_ctes("oracle_best", True) + [SCORES],
    f"""select symbol, w.ts, {", ".join(f"w.{c}" for c in _BOOLEANS)}, {", ".join(r6(f"w.{c}", c) for c in _EVERY)},
      cast(direction_label as bigint) as direction_label, direction_name, {rolled(*LABEL_DOUBLES)}, exit_reason,
      cast(bars_to_exit as bigint) as bars_to_exit, sma_filter_used, labeling_mode, entry_mode, label_valid,
      cast(direction_label as bigint) as oracle_direction_label, direction_name as oracle_direction_name,
      {r6("bull::double", "confirmation_bull_score")}, {r6("bear::double", "confirmation_bear_score")},
      {r6("score::double", "confirmation_score")}, {r6("edge::double", "confirmation_edge")},
      false as confirmation_filter_used,
      case when direction_label = 1 then 'oracle_neutral' else 'filter_disabled' end as label_filter_reason
    from whole w join scored using (symbol, rn)""",
)

# The minimum of a smooth loss: no slope by any weight
_NAMES = ", ".join(f"('{name}')" for name in (*MODEL_FEATURES, "constant"))
ORACLES["joint_model_gradient"] = statement(
    DATASET + [SCALED],
    f"""select head, feature, 0.0::double as gradient, rows
    from (values ('logit'), ('up_pred'), ('dn_pred')) h(head), (values {_NAMES}) f(feature),
      (select count(*) as rows from z where split = 'train')""",
)
