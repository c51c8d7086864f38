"""First bar ahead that reaches a price: range extremes over powers of two, descended by binary steps.

A block's rows become one array in time order, with the extremes of the next 1, 2, 4, ... rows at every place beside
it. The first row that reaches a price is found by skipping the largest spans whose extreme does not, so a search
costs the logarithm of its limit, and any number of prices share the arrays. Rows come back on the same layout.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.plans.blocks import BLOCK, POS, Blocked

ROWS = "_rows"


@dataclass(frozen=True)
class Ahead:
    """Blocks as arrays of rows with the extremes of up to `limit` rows ahead; `place` is a row's index in its block."""

    df: DataFrame
    b: Blocked
    limit: int
    uppers: str = "_uppers"
    lowers: str = "_lowers"
    place: str = "i"

    @property
    def levels(self) -> int:
        return max(self.limit, 1).bit_length()

    def reach(self, price: str, upper: bool, limit: str | None = None) -> str:
        """Step (from 1) at which the high first reaches the price from below, or the low from above; NULL if it does
        not within the limit. SQL text for use inside `rows`."""
        table, short = (self.uppers, "<") if upper else (self.lowers, ">")
        meets = ">=" if upper else "<="
        limit = str(self.limit) if limit is None else limit
        powers = ", ".join(str(k) for k in reversed(range(self.levels)))
        skip = f"p + shiftleft(1, k) <= {limit} and get(get({table}, k), {self.place} + 1 + p) {short} {price}"
        found = f"p < {limit} and get(get({table}, 0), {self.place} + 1 + p) {meets} {price}"
        return f"aggregate(array({powers}), 0, (p, k) -> if({skip}, p + shiftleft(1, k), p), p -> if({found}, p + 1, null))"

    def at(self, column: str, steps: str) -> str:
        """Value of a column some steps ahead, NULL past the end of the block."""
        return f"get({ROWS}, {self.place} + {steps}).{column}"

    def rows(self, added: dict[str, str], drop: Iterable[str] = (), row: str = "r") -> Blocked:
        """The rows with columns more; the texts see a row as `r` and its place as `i`."""
        gone = {*drop, *self.b.keys, BLOCK}
        kept = [c for c in self.b.df.columns if c not in gone]
        fields = [f"'{c}', {row}.{c}" for c in kept] + [f"'{name}', {text}" for name, text in added.items()]
        made = f"inline(transform({ROWS}, ({row}, {self.place}) -> named_struct({', '.join(fields)})))"
        return Blocked(self.df.selectExpr(*self.b.keys, BLOCK, made), self.b.keys, self.b.segments)


def ahead_of(b: Blocked, limit: int, high: str = "high", low: str = "low") -> Ahead:
    """Blocks of `b`, whose copies must reach `limit` rows on."""
    rest = [c for c in b.df.columns if c not in (*b.keys, BLOCK, POS)]
    rows = F.sort_array(F.collect_list(F.struct(POS, *rest)))  # a place stands once in a block
    df = b.df.groupBy(*b.keys, BLOCK).agg(rows.alias(ROWS))
    df = df.selectExpr("*", f"transform({ROWS}, r -> r.{high}) as _up0", f"transform({ROWS}, r -> r.{low}) as _low0")
    levels = max(limit, 1).bit_length()
    for k in range(1, levels):
        span = 1 << (k - 1)
        over = f"transform(sequence(0, size({ROWS}) - 1), i -> %s(get(%s{k - 1}, i), get(%s{k - 1}, i + {span})))"
        df = df.selectExpr("*", f"{over % ('greatest', '_up', '_up')} as _up{k}", f"{over % ('least', '_low', '_low')} as _low{k}")
    up, low_ = (", ".join(f"{name}{k}" for k in range(levels)) for name in ("_up", "_low"))
    return Ahead(df.selectExpr(*b.keys, BLOCK, ROWS, f"array({up}) as _uppers", f"array({low_}) as _lowers"), b, limit)
