"""Positions inside a series and row blocks with copied edges.

A window partitioned by symbol puts a whole series into one task. Here a series is numbered first, then
cut into blocks of `rows` consecutive bars; each block also receives copies of the last `back` bars before
it and the first `ahead` bars after it. Any frame that looks at most that far gives the same value inside
a block as over the whole series, so all of them run on (symbol, block) behind one exchange and one sort,
however long a single series is.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import KEYS
from barloom.functions.scalar import local_seconds

POS, TOTAL, BLOCK, CORE = "rn", "n", "blk", "in_core"
BLOCK_ROWS = 1 << 15
SPAN = 16
PIECE = 64
TILE_SECONDS = 30 * 86400
BYTES_PER_TASK = 32 << 20
MAX_TASKS = 100_000
UNKNOWN_SIZE = 1 << 60


def number_rows(
    df: DataFrame, keys: Iterable[str] = KEYS, ts: str = "ts", tile_seconds: int = TILE_SECONDS
) -> DataFrame:
    """Add the 0-based position `rn` and the series length `n`.

    Rows are counted per calendar tile (map-side combined) and the running count over tiles gives each
    tile its offset, so only a tile is ever sorted by one task. A series has one row per `ts`, hence a tile
    holds at most tile_seconds / bar width rows and a series has at most span / tile_seconds tiles.
    """
    keys = list(keys)
    tiled = df.withColumn("_tile", F.floor(local_seconds(F.col(ts)) / tile_seconds))
    in_order = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, 0)
    offsets = (
        tiled.groupBy(*keys, "_tile")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            *keys,
            "_tile",
            (F.sum("_rows").over(in_order) - F.col("_rows")).alias("_before"),
            F.sum("_rows").over(Window.partitionBy(*keys)).alias(TOTAL),
        )
    )
    in_tile = Window.partitionBy(*keys, "_tile").orderBy(ts)
    return (
        tiled.join(offsets, [*keys, "_tile"])
        .withColumn(POS, F.row_number().over(in_tile) - F.lit(1) + F.col("_before"))
        .drop("_tile", "_before")
    )


def number_short_series(df: DataFrame, keys: Iterable[str] = KEYS, ts: str = "ts") -> DataFrame:
    """`number_rows` with plain windows, for bars of an hour or wider: the calendar allows 8,784 a year."""
    whole = Window.partitionBy(*keys)
    return df.withColumns(
        {POS: F.row_number().over(whole.orderBy(ts)).cast("long") - 1, TOTAL: F.count(F.lit(1)).over(whole)}
    )


def decay_rate(alpha: float) -> float:
    return -math.log1p(-alpha)


def memory_rows(alpha: float) -> int:
    """Rows after which the weight of a value has fallen below e^-64.

    From e^-37, half an ulp of a double, on two recursions over the same values can only lie a few bits apart; the rest
    is for these to meet, so that copied edges give the bits of the whole series.
    """
    return math.ceil(64.0 / decay_rate(alpha))


def segment_sizes(alphas: Iterable[float], largest: int = BLOCK_ROWS) -> tuple[int, ...]:
    """Nested power-of-two segment lengths so that every alpha has one with 39 <= rate * length <= 650.

    The upper bound keeps q^-length inside a double; the lower one makes the carry of the segment before
    the last one vanish, so one carry per segment is exact.
    """
    sizes: list[int] = []
    for rate in sorted({decay_rate(a) for a in alphas}, reverse=True):
        if not any(39.0 <= rate * size <= 650.0 for size in sizes):
            size = 1 << int(math.log2(650.0 / rate))
            if size < 2 or rate * size < 39.0:
                raise ValueError(f"no segment length fits decay rate {rate}")
            sizes.append(size)
    if sizes and max(sizes) > 64 * largest:
        raise ValueError("smoothing factor too small for block-wise evaluation")
    return tuple(sorted(sizes, reverse=True))


def fits_blocks(alpha: float) -> bool:
    """Whether `Blocked.ewm` can smooth with this weight; `scan.smoothed` can with any."""
    if not 0.0 < alpha < 1.0:
        return False
    try:
        return bool(segment_sizes([alpha]))
    except ValueError:
        return False


def back(trail: str, k: int) -> str:
    """Value k rows ago from a `Blocked.trail`; NULL where the series has no such row."""
    return f"get({trail}, size({trail}) - {k + 1})"


@dataclass(frozen=True)
class Ewm:
    """Request for one exponentially weighted mean: input, weight, values needed, leading missing values."""

    source: str
    alpha: float
    min_periods: int
    skip: int = 0


@dataclass(frozen=True)
class Extreme:
    """Request for one rolling extreme: max or min, column, size, values needed (all without a number), and how many
    leading values of a series are missing (not known without a number)."""

    fn: str
    source: str
    size: int
    min_periods: int | None = None
    skip: int | None = None


@dataclass(frozen=True)
class Blocked:
    """A numbered frame cut into blocks; every method adds columns (as SQL text) and keeps the layout."""

    df: DataFrame
    keys: tuple[str, ...]
    segments: tuple[int, ...] = ()

    def window(self, frame: str = "", level: int = 0) -> str:
        """Window over the block, or over its segments down to `level`; all of them share one sort."""
        names = [f"_seg{s}" for s in self.segments]
        parts = ", ".join([*self.keys, BLOCK, *names[:level]])
        order = ", ".join([*names[level:], POS])
        return f"over (partition by {parts} order by {order} {frame})"

    def with_columns(self, columns: dict[str, str]) -> Blocked:
        """Add new columns in one projection; they cannot refer to each other."""
        if not columns:
            return self
        return replace(self, df=self.df.selectExpr("*", *[f"{text} as {name}" for name, text in columns.items()]))

    def drop(self, *names: str) -> Blocked:
        return replace(self, df=self.df.drop(*names))

    def drop_scratch(self) -> Blocked:
        return self.drop(*[x for x in self.df.columns if x.startswith("_") and not x.startswith("_seg")])

    def lag(self, x: str, k: int) -> str:
        return f"lag({x}, {k}) {self.window()}"

    def trail(self, x: str, size: int) -> str:
        """Array of the last `size` values, newest last; `back` reads it. One frame instead of a lag per offset."""
        return f"collect_list({x}) {self.window(f'rows between {size - 1} preceding and current row')}"

    def roll(self, fn: str, x: str, size: int, skip: int | None = None, min_periods: int | None = None) -> str:
        """Rolling aggregate over the last `size` rows; NULL until `min_periods` (default all) values are there.

        `skip` states that only the first `skip` values of a series are missing, which saves the count.
        """
        over = self.window(f"rows between {size - 1} preceding and current row")
        need = size if min_periods is None else min_periods
        if need <= 1:
            return f"{fn}({x}) {over}"
        full = f"{POS} >= {skip + need - 1}" if skip is not None else f"count({x}) {over} >= {need}"
        return f"case when {full} then {fn}({x}) {over} end"

    def extremes(self, requests: dict[str, Extreme]) -> Blocked:
        """Rolling maxima and minima of any size, each row at the cost of a few offsets instead of its whole frame.

        The extreme of the last 16 rows is a frame; that of 256, 4096, ... rows is taken from 16 of the next narrower
        ones, and any size from at most 16 overlapping spans of the widest that fits (overlaps do not change an
        extreme). Spans of one width are one Window node for all requests.
        """
        width = lambda size: SPAN ** max(int(math.log(size, SPAN) + 1e-9), 0)
        wide = [r for r in requests.values() if r.size > SPAN]
        name = lambda r, w: r.source if w == 1 else f"_{r.fn}{w}_{r.source}"

        def combined(r: Extreme, w: int, size: int) -> str:
            places = sorted({*range(0, size - w, w), size - w})
            parts = [f"lag({name(r, w)}, {k}) {self.window()}" if k else name(r, w) for k in places]
            return f"{'greatest' if r.fn == 'max' else 'least'}({', '.join(parts)})" if len(parts) > 1 else parts[0]

        def full(r: Extreme, text: str) -> str:
            need = r.size if r.min_periods is None else r.min_periods
            if need <= 1:
                return text
            frame = self.window(f"rows between {r.size - 1} preceding and current row")
            there = f"{POS} >= {r.skip + need - 1}" if r.skip is not None else f"count({r.source}) {frame} >= {need}"
            return f"case when {there} then {text} end"

        step, w = self, SPAN
        while any(width(r.size) >= w for r in wide):
            made = {name(r, w): self.roll(r.fn, r.source, SPAN, min_periods=1) if w == SPAN else combined(r, w // SPAN, w)
                    for r in wide if width(r.size) >= w}
            step, w = step.with_columns(made), w * SPAN
        texts = {out: combined(r, width(r.size), r.size) if r.size > SPAN else self.roll(r.fn, r.source, r.size, min_periods=1)
                 for out, r in requests.items()}
        step = step.with_columns({out: full(requests[out], text) for out, text in texts.items()})
        return step.drop(*{name(r, SPAN**k) for r in wide for k in range(1, 8)})

    def forward(self, fn: str, x: str, size: int) -> str:
        """Aggregate over the next `size` rows, without the row itself."""
        return f"{fn}({x}) {self.window(f'rows between 1 following and {size} following')}"

    def ewm(self, requests: dict[str, Ewm]) -> Blocked:
        """Exponentially weighted means y0 = x0, y = (1-a) y + a x, several in one pass.

        With g = q^p inside a segment of the series, y = g * (sum(u / g) + q * y_end_of_previous_segment):
        a running sum per segment and the last value of the segment before.
        """
        level_of = {}
        for req in requests.values():
            rate = decay_rate(req.alpha)
            fits = [i for i, s in enumerate(self.segments) if 39.0 <= rate * s <= 650.0]
            if not fits:
                raise ValueError(f"layout has no segment for alpha {req.alpha}")
            level_of[req.alpha] = fits[-1]
        offset = {a: f"pmod({POS}, {self.segments[lv]})" for a, lv in level_of.items()}
        decay = {a: f"_g{i}" for i, a in enumerate(level_of)}
        step = self.with_columns({g: f"pow({1.0 - a!r}D, {offset[a]})" for a, g in decay.items()})
        step = step.with_columns(
            {
                f"_u_{name}": f"(case when {POS} = {r.skip} then {r.source} "
                f"when {POS} > {r.skip} then {r.alpha!r}D * ({r.source}) end) / {decay[r.alpha]}"
                for name, r in requests.items()
            }
        )
        for lv in sorted(set(level_of.values())):
            over = self.window("rows between unbounded preceding and current row", lv + 1)
            mine = [name for name, r in requests.items() if level_of[r.alpha] == lv]
            step = step.with_columns({f"_s_{name}": f"sum(_u_{name}) {over}" for name in mine})
        before = self.window("rows between unbounded preceding and 1 preceding")
        step = step.with_columns(
            {
                f"_c_{name}": f"last(case when {offset[r.alpha]} = {self.segments[level_of[r.alpha]] - 1} "
                f"then _s_{name} * {decay[r.alpha]} end, true) {before}"
                for name, r in requests.items()
            }
        )
        step = step.with_columns(
            {
                name: f"case when {POS} >= {r.skip + r.min_periods - 1} then {decay[r.alpha]} * "
                f"(coalesce(_s_{name}, 0D) + coalesce(_c_{name} * {1.0 - r.alpha!r}D, 0D)) end"
                for name, r in requests.items()
            }
        )
        return step.drop(*[f"_{tag}_{name}" for tag in "usc" for name in requests], *decay.values())

    def recursive(self, requests: dict[str, Ewm]) -> Blocked:
        """`ewm` row by row: y0 = x0, y = (1-a) y + a x, with the bits of that recursion; a missing value keeps y.

        On flat prices means of different weights are equal but for their last bits, and comparing them compares these
        bits. A block's rows become one array, which is folded in pieces, so that appending stays cheap; the rows come
        back on the same layout, for one more sort.
        """
        kept = [c for c in self.df.columns if c not in (*self.keys, BLOCK)]
        inputs = {f"_u_{name}": r.source for name, r in requests.items()}
        rest = [c for c in kept if c != POS]
        rows = F.sort_array(F.collect_list(F.struct(POS, *rest, *inputs)))  # a place stands once in a block
        df = self.with_columns(inputs).df.groupBy(*self.keys, BLOCK).agg(rows.alias("_rows"))
        folds = []
        for name, r in requests.items():
            x, y = f"v._u_{name}", "element_at(ys, -1)"
            next_y = f"case when {x} is null then {y} when {y} is null then {x} else {1.0 - r.alpha!r}D * {y} + {r.alpha!r}D * {x} end"
            piece = f"aggregate(slice(_rows, k, {PIECE}), array(element_at(element_at(done, -1), -1)), (ys, v) -> array_append(ys, {next_y}))"
            pieces = f"aggregate(sequence(1, size(_rows), {PIECE}), array(array(double(null))), (done, k) -> array_append(done, {piece}))"
            # the first piece is the empty start, and a piece begins with the last value of the one before
            folds.append(f"flatten(transform(slice({pieces}, 2, size(_rows)), ys -> slice(ys, 2, {PIECE}))) as _y_{name}")
        fields = [f"'{c}', r.{c}" for c in kept]
        fields += [f"'{name}', case when r.{POS} >= {r.skip + r.min_periods - 1} then get(_y_{name}, i) end" for name, r in requests.items()]
        made = f"inline(transform(_rows, (r, i) -> named_struct({', '.join(fields)})))"
        folded = df.selectExpr(*self.keys, BLOCK, "_rows", *folds)
        return replace(self, df=folded.selectExpr(*self.keys, BLOCK, made))

    def core(self) -> DataFrame:
        """The rows the blocks own, without copies and layout columns."""
        names = [f"_seg{s}" for s in self.segments]
        return self.df.where(F.col(CORE)).drop(CORE, BLOCK, *names)


def block_partitions(df: DataFrame) -> int:
    """Tasks for block-wise work: the session's shuffle width, or more when the input's size asks for it.

    Block-wise work is compute-heavy for its size, so a small input is not folded into one task.
    """
    spark = df.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(s for s in sizes if s < UNKNOWN_SIZE)
    return max(width, min(math.ceil(size / BYTES_PER_TASK), MAX_TASKS))


def in_blocks(
    df: DataFrame,
    back: int = 0,
    ahead: int = 0,
    alphas: Iterable[float] = (),
    keys: Iterable[str] = KEYS,
    rows: int = BLOCK_ROWS,
    segments: Iterable[int] | None = None,
) -> Blocked:
    """Lay a numbered frame out in blocks whose frames may reach `back` rows back and `ahead` rows on.

    `segments` gives nested segment lengths (widest first) instead of those that the weights `alphas` need.
    """
    sizes = segment_sizes(alphas) if segments is None else tuple(segments)
    rows = max(rows, back, ahead)
    own = F.floor(F.col(POS) / rows)
    first = F.greatest(F.floor((F.col(POS) - ahead) / rows), F.lit(0).cast("long"))
    last = F.least(F.floor((F.col(POS) + back) / rows), F.floor((F.col(TOTAL) - 1) / rows))
    spread = df.withColumn("_own", own).withColumn(BLOCK, F.explode(F.sequence(first, last)))
    spread = spread.withColumn(CORE, F.col(BLOCK) == F.col("_own")).drop("_own")
    spread = spread.withColumns({f"_seg{s}": F.floor(F.col(POS) / s) for s in sizes})
    # One exchange for every window that follows, whichever segment level it is partitioned by.
    return Blocked(spread.repartition(block_partitions(df), *keys, BLOCK), tuple(keys), sizes)


def as_one_block(df: DataFrame, alphas: Iterable[float] = (), keys: Iterable[str] = KEYS) -> Blocked:
    """Number short series (hours or wider, see `number_short_series`) and keep each in one block.

    Numbering and all windows then share the exchange by key.
    """
    keys, sizes = tuple(keys), segment_sizes(alphas)
    one = number_short_series(df, keys).withColumns({BLOCK: F.lit(0).cast("long"), CORE: F.lit(True)})
    return Blocked(one.withColumns({f"_seg{s}": F.floor(F.col(POS) / s) for s in sizes}), keys, sizes)
