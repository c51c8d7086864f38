"""Backward as-of join of two tables on keys and time."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.config import KEYS
from barloom.functions.scalar import local_seconds
from barloom.plans.blocks import TILE_SECONDS
from barloom.plans.scan import forward_fill


def _tile(ts: Column, kind: T.DataType, seconds: int) -> Column:
    at = F.unix_seconds(ts) if isinstance(kind, T.TimestampType) else local_seconds(ts)
    return F.floor(at / seconds)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Iterable[str] = KEYS,
    ts: str = "ts",
    right_ts: str | None = None,
    tie: Iterable[str] = (),
    tolerance_seconds: float | None = None,
    strict: bool = False,
    how: str = "left",
    prefix: str = "right_",
    tile_seconds: int = TILE_SECONDS,
) -> DataFrame:
    """Each row of `left` with the last row of `right` that has its keys and is not later; `right`'s columns but the
    keys get the prefix.

    Of equal times the row that is last by the `tie` columns counts. `strict` wants an earlier time, and a tolerance
    one at most so many seconds back. Rows of `left` without a match, or with a NULL key or time, have NULLs (`how`
    left) or go (inner). Both tables go through one exchange by key and tile of time; the last row of a tile is handed
    on to the next ones, so a series of any length is spread, and nothing is compared row by row.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    keys, tie = list(keys), list(tie)
    right_ts = right_ts or ts
    kinds = left.schema[ts].dataType, right.schema[right_ts].dataType
    if kinds[0] != kinds[1]:
        raise ValueError(f"times of different types: {kinds[0].simpleString()} and {kinds[1].simpleString()}")
    rest = [c for c in right.columns if c not in keys]
    names = [f"{prefix}{c}" for c in rest]
    if set(names) & set(left.columns):
        raise ValueError(f"columns of both tables: {sorted(set(names) & set(left.columns))}; choose another prefix")
    ids = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    places = [f"_k{i}" for i in range(len(keys))]
    known = lambda t: [F.col(c).isNotNull() for c in (*keys, t)]
    whole = lambda df: F.struct(*df.columns)

    def rows(df: DataFrame, t: str, side: int, ours: Column, theirs: Column, order: list[Column]) -> DataFrame:
        usable = F.lit(True)
        for x in known(t):
            usable = usable & x
        return df.where(usable).select(*ids, F.col(t).alias("_at"), F.lit(side).alias("_side"), *order, ours.alias("_ours"), theirs.alias("_theirs"))

    ties = [f"_t{i}" for i in range(len(tie))]
    none = lambda kind: F.lit(None).cast(kind)
    mine = rows(left, ts, 0 if strict else 1, whole(left), none(whole_type(right)), [none(right.schema[c].dataType).alias(t) for c, t in zip(tie, ties, strict=True)])
    found = rows(right, right_ts, 1 if strict else 0, none(whole_type(left)), whole(right), [F.col(c).alias(t) for c, t in zip(tie, ties, strict=True)])
    both = mine.unionByName(found)
    filled = forward_fill(both, ["_theirs"], _tile(F.col("_at"), kinds[0], tile_seconds), ["_at", "_side", *ties], places)
    near = F.col(f"_theirs.{right_ts}")
    match = F.col("_theirs").isNotNull()
    if tolerance_seconds is not None:
        match = match & (F.col("_at") <= near + F.make_dt_interval(secs=F.lit(float(tolerance_seconds))))
    filled = filled.where(F.col("_ours").isNotNull()).withColumn("_theirs", F.when(match, F.col("_theirs")))
    if how == "inner":
        filled = filled.where(F.col("_theirs").isNotNull())
    out = filled.select("_ours.*", *[F.col(f"_theirs.{c}").alias(n) for c, n in zip(rest, names, strict=True)])
    if how == "inner":
        return out
    lost = F.lit(False)
    for x in known(ts):
        lost = lost | ~x
    alone = left.where(lost).select("*", *[none(right.schema[c].dataType).alias(n) for c, n in zip(rest, names, strict=True)])
    return out.unionByName(alone)


def whole_type(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
