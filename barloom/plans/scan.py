"""Running totals and carried values over whole series, without one task per series.

Each scan has two levels: a window inside a tile of the series, and a window over one summary row per tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import KEYS
from barloom.plans.blocks import BLOCK_ROWS, POS, TOTAL, Ewm, decay_rate, in_blocks
from barloom.plans.settle import settle

#: Segments whose carries one window puts together.
GROUP = 4096


def running(
    df: DataFrame,
    tile: Column,
    order: Iterable[str],
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    keys: Iterable[str] = KEYS,
    products: dict[str, Column] | None = None,
) -> DataFrame:
    """Add inclusive running sums, maxima and products of each series; NULL is left out. `tile` must not decrease
    along `order`."""
    keys, order = list(keys), list(order)
    wanted = [(name, F.sum, F.col(f"_x_{name}")) for name in sums or {}]
    wanted += [(name, F.max, F.col(f"_x_{name}")) for name in maxima or {}]
    wanted += [(name, F.product, F.col(f"_x_{name}")) for name in products or {}]
    given = {**(sums or {}), **(maxima or {}), **(products or {})}
    inputs = {f"_x_{name}": expr for name, expr in given.items()}
    tiled = df.withColumns({"_tile": tile, **inputs})
    earlier = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tiled.groupBy(*keys, "_tile")
        .agg(*[fn(x).alias(f"_t_{name}") for name, fn, x in wanted])
        .select(*keys, "_tile", *[fn(f"_t_{name}").over(earlier).alias(f"_o_{name}") for name, fn, _ in wanted])
    )
    inside = Window.partitionBy(*keys, "_tile").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = tiled.join(offsets, [*keys, "_tile"]).withColumns({f"_r_{n}": fn(x).over(inside) for n, fn, x in wanted})
    joined = joined.withColumns(
        {
            name: F.greatest(f"_o_{name}", f"_r_{name}")
            if fn is F.max
            else F.coalesce(
                F.col(f"_o_{name}") + F.col(f"_r_{name}") if fn is F.sum else F.col(f"_o_{name}") * F.col(f"_r_{name}"),
                F.col(f"_r_{name}"),
                F.col(f"_o_{name}"),
            )
            for name, fn, _ in wanted
        }
    )
    scratch = [f"_{tag}_{name}" for tag in "xor" for name, _, _ in wanted]
    return joined.drop("_tile", *scratch)


def forward_fill(
    df: DataFrame,
    columns: Iterable[str],
    tile: Column,
    order: Iterable[str],
    keys: Iterable[str] = KEYS,
) -> DataFrame:
    """Replace NULL by the last earlier value of the series, however far back it lies."""
    keys, order, columns = list(keys), list(order), list(columns)
    tiled = df.withColumn("_tile", tile)
    inside = Window.partitionBy(*keys, "_tile").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(*[F.col(o) for o in order])
    ends = tiled.groupBy(*keys, "_tile").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"_e_{c}") for c in columns]
    )
    earlier = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys, "_tile", *[F.last(f"_e_{c}", ignorenulls=True).over(earlier).alias(f"_c_{c}") for c in columns]
    )
    filled = tiled.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})
    return (
        filled.join(carried, [*keys, "_tile"])
        .withColumns({c: F.coalesce(F.col(c), F.col(f"_c_{c}")) for c in columns})
        .drop("_tile", *[f"_c_{c}" for c in columns])
    )


def max_drawdown(
    df: DataFrame,
    factor: Column,
    tile: Column,
    order: Iterable[str],
    keys: Iterable[str],
    start_at_one: bool = False,
) -> DataFrame:
    """Worst relative fall (<= 0) of the running product of `factor` below its earlier peak, per key.

    The product is a plain one, so factors of zero or less count as they are; NULL factors are left out. Product
    and peak are two-level scans: a long series is spread over its tiles. `start_at_one` counts the starting value
    as a peak.
    """
    keys, order = list(keys), list(order)
    rows = df.select(*keys, tile.alias("_at"), *order, factor.alias("_f"))
    curve = running(rows, F.col("_at"), order, keys=keys, products={"_eq": F.col("_f")})
    peaked = running(curve, F.col("_at"), order, keys=keys, maxima={"_peak": F.col("_eq")})
    peak = F.greatest(F.col("_peak"), F.lit(1.0)) if start_at_one else F.col("_peak")
    fall = F.least(F.min(F.try_divide(F.col("_eq"), peak) - 1.0), F.lit(0.0))
    return peaked.groupBy(*keys).agg(fall.alias("max_drawdown"))


def segment_of(alpha: float) -> int:
    """Largest power of two, a block at most, over which the weight of the first row stays a normal double."""
    rate = decay_rate(alpha) if alpha < 1.0 else math.inf
    return 1 << min(int(math.log2(max(650.0 / rate, 1.0))), BLOCK_ROWS.bit_length() - 1)


def _composed(ends: DataFrame, names: list[str], factors: dict[str, float], longest: int, keys: list[str]) -> DataFrame:
    """y[k] = x[k] + factor * y[k - 1] along `_at` (0, 1, ... without gaps), for every column of `names`.

    Inside a group of segments the pairs are put together by doubling: after step j a row has all of the last 2^j
    ones. Ends of groups are composed the same way, and their carry reaches a group by one join. Nothing is left out
    unless its factor is 0 in double precision.
    """
    grouped = longest > GROUP
    group = F.floor(F.col("_at") / GROUP).alias("_grp")
    step = ends.select("*", group) if grouped else ends.select("*", F.lit(0).alias("_grp"))
    order = Window.partitionBy(*keys, "_grp").orderBy("_at")
    span = 1
    while span < min(longest, GROUP):
        moved = {n: F.col(n) + F.coalesce(F.lag(n, span).over(order) * factors[n] ** span, F.lit(0.0)) for n in names if factors[n] ** span > 0.0}
        if not moved:
            break
        step, span = step.withColumns(moved), span * 2
    if not grouped:
        return step.drop("_grp")
    last = step.where(F.col("_at") % GROUP == GROUP - 1).select(*keys, F.col("_grp").alias("_at"), *names)
    carry = _composed(last, names, {n: factors[n] ** GROUP for n in names}, -(-longest // GROUP), keys)
    carry = carry.select(*keys, (F.col("_at") + 1).alias("_grp"), *[F.col(n).alias(f"_b_{n}") for n in names])
    joined = step.join(carry, [*keys, "_grp"], "left")
    reach = F.col("_at") % GROUP + 1
    return joined.select(*keys, "_at", *[(F.col(n) + F.coalesce(F.pow(F.lit(factors[n]), reach) * F.col(f"_b_{n}"), F.lit(0.0))).alias(n) for n in names])


def smoothed(df: DataFrame, requests: dict[str, Ewm], keys: Iterable[str] = KEYS) -> DataFrame:
    """Exponentially weighted means of a numbered frame with any weight in (0, 1], however slowly it forgets.

    A row maps the mean before it to factor * mean + offset. Inside a segment these maps are composed by a running
    sum, the segments' maps by doubling over one row per segment, and a row adds what reaches its segment. No row is
    copied and no weight is cut off. Columns have no missing values but the first `skip` ones of a series.
    """
    keys = list(keys)
    for r in requests.values():
        if not 0.0 < r.alpha <= 1.0:
            raise ValueError(f"weight {r.alpha}: must be above 0 and at most 1")
    size = {name: segment_of(r.alpha) for name, r in requests.items()}
    sizes = sorted(set(size.values()), reverse=True)
    b = in_blocks(df, keys=keys, segments=sizes)
    keep = {name: 1.0 - r.alpha for name, r in requests.items()}
    g = {name: f"_g_{name}" for name in requests}
    b = b.with_columns({g[name]: f"pow({keep[name]!r}D, pmod({POS}, {size[name]}))" for name in requests})
    parts = {f"_u_{name}": f"coalesce(case when {POS} = {r.skip} then {r.source} when {POS} > {r.skip} then {r.alpha!r}D * ({r.source}) end, 0D) / {g[name]}" for name, r in requests.items()}
    b = b.with_columns(parts)
    for level, s in enumerate(sizes):
        over = b.window("rows between unbounded preceding and current row", level + 1)
        b = b.with_columns({f"_l_{name}": f"{g[name]} * sum(_u_{name}) {over}" for name in requests if size[name] == s})
    rows = settle(b.drop(*g.values(), *parts).core())
    longest = rows.agg(F.max(TOTAL)).first()[0] or 0
    for s in sizes:
        mine = [name for name in requests if size[name] == s]
        ends = rows.where(F.col(POS) % s == s - 1).select(*keys, F.floor(F.col(POS) / s).alias("_at"), *[F.col(f"_l_{n}").alias(n) for n in mine])
        carry = _composed(ends, mine, {n: keep[n] ** s for n in mine}, -(-longest // s), keys)
        carry = carry.select(*keys, (F.col("_at") + 1).alias("_seg"), *[F.col(n).alias(f"_c_{n}") for n in mine])
        rows = rows.withColumn("_seg", F.floor(F.col(POS) / s)).join(carry, [*keys, "_seg"], "left").drop("_seg")
    out = {}
    for name, r in requests.items():
        there = F.col(POS) >= r.skip + r.min_periods - 1
        reach = F.pow(F.lit(keep[name]), F.col(POS) % size[name] + 1)
        out[name] = F.when(there, F.col(f"_l_{name}") + F.coalesce(reach * F.col(f"_c_{name}"), F.lit(0.0)))
    return rows.withColumns(out).drop(*[f"_{tag}_{name}" for tag in "lc" for name in requests])
