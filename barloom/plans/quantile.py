"""Exact quantiles of groups of any size, by digits of the values' order-preserving bits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.plans.settle import settle

#: Bits of a double that each pass looks at, first digit first.
DIGITS = (22, 21, 21)
ALL_BUT_SIGN = (1 << 63) - 1


def order_bits(x: str) -> str:
    """A 64-bit integer that orders like the double `x` (-0 as 0, NaN above all)."""
    bits = f"cast(reflect('java.lang.Double', 'doubleToLongBits', {x} + 0D) as bigint)"
    return f"transform(array({bits}), b -> if(b < 0, b ^ {ALL_BUT_SIGN}, b))[0]"


def double_of(bits: str) -> str:
    """The double that `order_bits` made an integer of."""
    raw = f"if({bits} < 0, {bits} ^ {ALL_BUT_SIGN}, {bits})"
    return f"cast(reflect('java.lang.Double', 'longBitsToDouble', {raw}) as double)"


def _same(keys: Iterable[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def exact_quantiles(df: DataFrame, keys: Iterable[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles (column -> share) of the non-null `value`, one row per key with a value.

    Equal values are counted first (map-side combined) and written. Every pass counts the next digit of the values
    that share the digits found so far with a wanted rank, and picks the digit that rank falls on; after the last
    digit the value is known. No group is held in memory or sorted by one task: a pass sees at most 2^22 counts of a
    key and wanted place, whatever the values' scale.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    counts = settle(counts.selectExpr(*keys, f"{order_bits('_x')} as _bits", "_c"))
    wanted, left, above = None, 64, []
    for width in DIGITS:
        left -= width
        digits = counts.withColumn("_next", F.shiftright("_bits", left))
        if wanted is not None:
            known = wanted.select(*keys, "_found").distinct()
            near = digits.withColumn("_found", F.shiftright("_next", width)).alias("a").join(known.alias("b"), _same([*keys, "_found"], "a", "b"), "left_semi")
            digits = near.select("a.*")
            above = ["_found"]
        sums = digits.groupBy(*keys, *above, "_next").agg(F.sum("_c").alias("_sum"))
        place = Window.partitionBy(*keys, *above)
        end = F.sum("_sum").over(place.orderBy("_next").rowsBetween(Window.unboundedPreceding, 0))
        sums = sums.select("*", (end - F.col("_sum")).alias("_start"), end.alias("_end"), *([] if above else [F.sum("_sum").over(place).alias("_n")]))
        if wanted is None:
            ranks = [((F.col("_n") - 1) * F.lit(float(q))).alias(name) for name, q in quantiles.items()]
            ends = [F.struct(F.lit(f"{name}{side}").alias("_name"), fn(r).cast("long").alias("_rank"), (r - F.floor(r)).alias("_w"))
                    for name, r in zip(quantiles, ranks, strict=True) for side, fn in (("<", F.floor), (">", F.ceil))]
            hit = sums.select(*keys, "_next", "_start", "_end", F.inline(F.array(*ends)))
        else:
            hit = sums.alias("a").join(wanted.alias("b"), _same([*keys, "_found"], "a", "b")).select("a.*", "b._name", "b._rank", "b._w")
        hit = hit.where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_end")))
        wanted = hit.select(*keys, F.col("_next").alias("_found"), "_name", (F.col("_rank") - F.col("_start")).alias("_rank"), "_w")
    exact = wanted.selectExpr(*keys, "_name", "_w", f"{double_of('_found')} as _x")
    picked = lambda name, column: F.max(F.when(F.col("_name") == name, F.col(column)))
    ends = exact.groupBy(*keys).agg(*[picked(f"{n}{side}", "_x").alias(f"{n}{side}") for n in quantiles for side in "<>"], *[picked(f"{n}<", "_w").alias(f"{n}=") for n in quantiles])
    low, high, share = (lambda n: F.col(f"`{n}<`")), (lambda n: F.col(f"`{n}>`")), (lambda n: F.col(f"`{n}=`"))
    between = lambda n: F.when(low(n) == high(n), low(n)).otherwise(low(n) + (high(n) - low(n)) * share(n))
    return ends.select(*keys, *[between(n).alias(n) for n in quantiles])


def exact_quantile(df: DataFrame, keys: Iterable[str], value: str, q: float, out: str) -> DataFrame:
    """One of `exact_quantiles`."""
    return exact_quantiles(df, keys, value, {out: q})
