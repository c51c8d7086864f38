"""Bars from ticks, from candle payloads and from files; de-duplication and checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.config import KEYS
from barloom.functions.names import INTERVAL_SECONDS
from barloom.functions.scalar import from_local_seconds, local_seconds

BAR_COLUMNS = ("open", "high", "low", "close", "volume")
BAR_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(name, T.DoubleType()) for name in BAR_COLUMNS]
)
PAYLOAD_TYPE = (
    "struct<success: boolean, result: array<struct<time: bigint, open: string, high: string, low: string, "
    "close: string, volume: string>>>"
)


def ticks_to_bars(
    ticks: DataFrame,
    bucket: Column,
    price: str,
    volume: str,
    order: Sequence[str],
    keys: Iterable[str] = KEYS,
) -> DataFrame:
    """First / highest / lowest / last price and summed volume per key and time bucket.

    Partial aggregation runs before the exchange, so a hot symbol arrives as one row per bucket and task.
    """
    place = F.struct(*order)
    return (
        ticks.withColumn("_bucket", bucket)
        .groupBy(*keys, "_bucket")
        .agg(
            F.min_by(price, place).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, place).alias("close"),
            F.sum(volume).alias("volume"),
        )
        .withColumnRenamed("_bucket", "ts")
    )


def bars_from_payloads(payloads: DataFrame, body: str = "body", time_zone: str | None = None) -> DataFrame:
    """Candle payloads (`success`, `result[]` with numbers as text) to typed bars.

    Payloads without success or rows give nothing; an empty or null volume becomes 0. A candle with a price or
    volume that is not a number is left out and reported by `malformed_candles`. `ts` is the
    UTC instant as a wall-clock time, or the wall clock of `time_zone`. The other columns are kept.
    """
    rows, good = _candles(payloads, body, time_zone)
    prices = [F.expr(f"try_cast(_c.{name} as double)").alias(name) for name in BAR_COLUMNS if name != "volume"]
    volume = F.coalesce(F.expr("try_cast(nullif(_c.volume, '') as double)"), F.lit(0.0))
    kept = [c for c in rows.columns if c != "_c"]
    return rows.where(good).select(*kept, *prices, volume.alias("volume"))


def malformed_candles(payloads: DataFrame, body: str = "body", time_zone: str | None = None) -> DataFrame:
    """The candles that `bars_from_payloads` leaves out, as they came, in `candle`: a price or volume that is there
    but not a number."""
    rows, good = _candles(payloads, body, time_zone)
    kept = [c for c in rows.columns if c != "_c"]
    return rows.where(~good).select(*kept, F.to_json("_c").alias("candle"))


def _candles(payloads: DataFrame, body: str, time_zone: str | None) -> tuple[DataFrame, Column]:
    """One row per candle with its fields in `_c`, and whether all its fields are numbers or missing."""
    kept = [c for c in payloads.columns if c != body]
    opened = payloads.select(*kept, F.from_json(body, PAYLOAD_TYPE).alias("_p")).where(F.col("_p.success"))
    rows = opened.select(*kept, F.posexplode("_p.result").alias("pos", "_c"))
    utc = from_local_seconds(F.col("_c.time"))
    ts = utc if time_zone is None else F.convert_timezone(F.lit("UTC"), F.lit(time_zone), utc)
    good = F.lit(True)
    for name in BAR_COLUMNS:
        given = f"nullif(_c.{name}, '')" if name == "volume" else f"_c.{name}"
        good = good & F.expr(f"{given} is null or try_cast({given} as double) is not null")
    return rows.select(*kept, "pos", ts.alias("ts"), "_c"), good


def first_of_duplicates(df: DataFrame, order: Sequence[str], keys: Iterable[str] = KEYS, ts: str = "ts") -> DataFrame:
    """One row per (key, ts): the first by `order`. Uses min_by, so copies collapse before the exchange."""
    keys = [*keys, ts]
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{c}") for c in rest])


def union_symbols(frames: dict[str, DataFrame]) -> DataFrame:
    """One long table from one frame per symbol; symbols without rows simply do not appear."""
    if not frames:
        raise ValueError("no frames given")
    out = None
    for symbol, frame in frames.items():
        tagged = frame.drop("symbol").withColumn("symbol", F.lit(symbol))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "columns") -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required {what}: {missing}")


def check_choice(name: str, value: str, allowed: Sequence[str]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {list(allowed)}")


def bar_contract(bars: DataFrame, keys: Iterable[str] = KEYS) -> DataFrame:
    """Violations per symbol of what the operators rely on: positive prices, high >= low, one row per ts."""
    keys = list(keys)
    require_columns(bars, [*keys, "ts", *BAR_COLUMNS])
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    missing = F.greatest(*[p.isNull().cast("int") for p in prices])
    low = F.greatest(*[F.coalesce((p <= 0).cast("int"), F.lit(0)) for p in prices])
    per_ts = bars.groupBy(*keys, "ts").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(missing).alias("missing"),
        F.sum(low).alias("low"),
        F.sum(F.coalesce((F.col("high") < F.col("low")).cast("int"), F.lit(0))).alias("crossed"),
        F.sum(F.col("volume").isNull().cast("int")).alias("no_volume"),
    )
    return per_ts.groupBy(*keys).agg(
        F.sum("rows").alias("bars"),
        F.sum("missing").alias("null_price"),
        F.sum("low").alias("non_positive_price"),
        F.sum("crossed").alias("high_below_low"),
        F.sum(F.col("rows") - 1).alias("duplicate_ts"),
        F.sum("no_volume").alias("null_volume"),
    )


def freshness(bars: DataFrame, now: Column, interval: str = "15m", keys: Iterable[str] = KEYS) -> DataFrame:
    """Age of the last bar of each symbol; stale from four intervals on. Unknown intervals count as 15 minutes."""
    limit = INTERVAL_SECONDS.get(interval, 900) * 4
    last = bars.groupBy(*keys).agg(F.max("ts").alias("last_ts"))
    age = local_seconds(now) - local_seconds(F.col("last_ts"))
    return last.withColumn("age_seconds", age).withColumn("stale", F.col("age_seconds") >= limit)


def backfill_manifest(
    bars: DataFrame,
    start: Column,
    end: Column,
    step_seconds: int,
    chunk_days: int = 7,
    keys: Iterable[str] = KEYS,
    requested: DataFrame | None = None,
) -> DataFrame:
    """Missing bars of each symbol on the grid [start, end), rolled up to request chunks.

    `requested` lists the symbols that are wanted, so that those without any bar show up as missing; without it
    they are the symbols that have bars.
    The expected count of a chunk is arithmetic, so only bars that exist are shuffled (one count per
    symbol and chunk after map-side combining); the grid itself is never generated. The counts of a symbol
    then fit a map with one entry per chunk of the span.
    """
    keys = list(keys)
    width = chunk_days * 86400
    t0, t1 = local_seconds(start), local_seconds(end)
    at = local_seconds(F.col("ts"))
    on_grid = (at >= t0) & (at < t1) & (F.pmod(at - t0, F.lit(step_seconds)) == 0)
    per_chunk = bars.groupBy(*keys, F.when(on_grid, F.floor((at - t0) / width)).alias("chunk")).agg(
        F.count_distinct("ts").alias("present")
    )
    entry = F.when(F.col("chunk").isNotNull(), F.struct("chunk", "present"))
    found = per_chunk.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_found"))
    if requested is not None:
        found = requested.select(*keys).distinct().join(found, keys, "left")
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((t1 - t0 - 1) / width))
    grid = found.select(*keys, "_found", F.explode(chunks).alias("chunk"))
    first = F.col("chunk") * width
    past = F.least((F.col("chunk") + 1) * width, t1 - t0)
    slots = F.ceil(past / step_seconds) - F.ceil(first / step_seconds)
    present = F.coalesce(F.try_element_at("_found", F.col("chunk")), F.lit(0).cast("long"))
    return grid.select(
        *keys,
        "chunk",
        from_local_seconds(t0 + first).alias("chunk_start"),
        from_local_seconds(t0 + past).alias("chunk_end"),
        slots.alias("expected"),
        present.alias("present"),
        (slots - present).alias("missing"),
    )


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", symbols: Sequence[str] | None = None) -> DataFrame:
    """Bars from parquet, CSV or JSON with a fixed schema; a symbol list becomes a pushed or partition filter."""
    reader = spark.read.schema(BAR_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", True)
    bars = reader.format(fmt).load(path)
    return bars.where(F.col("symbol").isin(list(symbols))) if symbols else bars


def write_bars(bars: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """One folder per symbol. Rows are spread by symbol and month first, so a hot symbol has many writers."""
    month = F.date_trunc("month", F.col("ts"))
    writer = bars.repartition("symbol", month).sortWithinPartitions("symbol", "ts").write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.partitionBy("symbol").format(fmt).save(path)


