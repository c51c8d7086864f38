"""Row-level column expressions shared by all operators. NULL means missing everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound x on either side and keep NULL (greatest/least would skip it)."""
    out = F.when(x < F.lit(lo), F.lit(lo)) if lo is not None else None
    if hi is not None:
        out = F.when(x > F.lit(hi), F.lit(hi)) if out is None else out.when(x > F.lit(hi), F.lit(hi))
    return x if out is None else out.otherwise(x)


def pct(num: Column, den: Column) -> Column:
    """Share in percent; 0 when the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")) * 100.0, F.lit(0.0))


def flag(cond: Column) -> Column:
    """Boolean with NULL read as false."""
    return F.coalesce(cond, F.lit(False))


def flag_float(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


def local_seconds(ts: Column) -> Column:
    """Seconds since 1970-01-01 on the wall clock that `ts` shows (no time zone shift for TIMESTAMP_NTZ)."""
    return (
        F.unix_date(F.to_date(ts)).cast("long") * 86400
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
        + F.second(ts)
    )


def from_local_seconds(seconds: Column) -> Column:
    """Inverse of `local_seconds` as TIMESTAMP_NTZ."""
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)


def code_name(code: Column, names: dict[int, str]) -> Column:
    """Name of an integer code, as a CASE chain."""
    out = None
    for value, name in names.items():
        out = F.when(code == value, name) if out is None else out.when(code == value, name)
    return out


def count_true(columns: list[str], inverted: frozenset[str], present: list[str]) -> Column:
    """Number of true flags; NULL counts as false before inversion, absent columns are skipped."""
    total = F.lit(0.0)
    for name in columns:
        if name in present:
            value = flag(F.col(name))
            total = total + flag_float(~value if name in inverted else value)
    return total
