"""Bars derived from the event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import from_local_seconds, local_seconds
from barloom.plans.blocks import number_rows
from barloom.plans.settle import settle
from barloom.sources.bars import ticks_to_bars

# Price path of the event table: starts at 1000 and moves by 0.05 x value per event, up for even ids.
START_PRICE = 1000
STEP_UNITS = 5
UNITS = 10_000
# Weeks whose bars are numbered together.
TILE_WEEKS = 4096


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hourly_event_bars(events: DataFrame) -> DataFrame:
    """Hourly bars of the price path of each event type, in exact 1/10000 units.

    The path is a running sum over a series of any length. It is taken per minute, minutes fold to hours
    (their open, high, low and close shift by the sum before them), and hours, bounded by the calendar,
    carry the level. The only exchange of event rows is by (type, minute).
    """
    cents = F.round(F.col("value") * 100).cast("long")
    step = F.when(F.col("event_id") % 2 == 0, cents).otherwise(-cents) * STEP_UNITS
    ticks = events.select(
        F.col("event_type").alias("symbol"),
        F.floor(local_seconds(F.col("ts")) / 60).alias("minute"),
        "ts",
        "event_id",
        cents.alias("cents"),
        step.alias("step"),
    )
    in_minute = Window.partitionBy("symbol", "minute").orderBy("ts", "event_id")
    up_to = in_minute.rowsBetween(Window.unboundedPreceding, 0)
    path = ticks.withColumns({"level": F.sum("step").over(up_to), "nr": F.row_number().over(in_minute)})
    minutes = path.groupBy("symbol", "minute").agg(
        F.max(F.when(F.col("nr") == 1, F.col("level"))).alias("first"),
        F.max("level").alias("high"),
        F.min("level").alias("low"),
        F.sum("step").alias("move"),
        F.sum("cents").alias("cents"),
    )
    in_hour = Window.partitionBy("symbol", "hour").orderBy("minute")
    base = F.sum("move").over(in_hour.rowsBetween(Window.unboundedPreceding, 0)) - F.col("move")
    leveled = minutes.withColumn("hour", F.floor(F.col("minute") / 60)).withColumns(
        {"base": base, "nr": F.row_number().over(in_hour)}
    )
    hours = leveled.groupBy("symbol", "hour").agg(
        F.max(F.when(F.col("nr") == 1, F.col("first"))).alias("first"),
        F.max(F.col("base") + F.col("high")).alias("high"),
        F.min(F.col("base") + F.col("low")).alias("low"),
        F.sum("move").alias("move"),
        F.sum("cents").alias("cents"),
    )
    over_hours = Window.partitionBy("symbol").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    level = F.lit(START_PRICE * UNITS) + F.sum("move").over(over_hours) - F.col("move")
    priced = hours.withColumn("level", level)

    def price(name: str):
        return ((F.col("level") + F.col(name)).cast("double") / UNITS).alias({"first": "open", "move": "close"}.get(name, name))

    return priced.select(
        "symbol",
        from_local_seconds(F.col("hour") * 3600).alias("ts"),
        price("first"),
        price("high"),
        price("low"),
        price("move"),
        (F.col("cents").cast("double") / 100).alias("volume"),
    )


def weekly_brand_bars(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Weekly bars of the unit price of each brand; line items are the ticks."""
    ticks = (
        lineitem.select(
            "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"
        )
        .join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("p_brand").alias("symbol"),
            "l_shipdate",
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            F.try_divide("l_extendedprice", "l_quantity").alias("price"),
            F.col("l_quantity").alias("quantity"),
        )
    )
    week = F.date_trunc("week", F.col("l_shipdate")).cast("timestamp_ntz")
    return ticks_to_bars(
        ticks, week, "price", "quantity", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    )


def daily_part_bars(lineitem: DataFrame) -> DataFrame:
    """Daily bars of the price per unit of each part: very many short series."""
    ticks = lineitem.select(
        F.col("l_partkey").cast("string").alias("symbol"),
        "l_shipdate",
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        F.col("l_quantity").alias("quantity"),
    )
    day = F.date_trunc("day", F.col("l_shipdate")).cast("timestamp_ntz")
    # lines that share order and number differ in price
    return ticks_to_bars(ticks, day, "price", "quantity", ["l_orderkey", "l_linenumber", "l_extendedprice"])


def hourly_bars(spark: SparkSession, folder: str) -> DataFrame:
    return hourly_event_bars(table(spark, folder, "events"))


def brand_bars(spark: SparkSession, folder: str) -> DataFrame:
    return weekly_brand_bars(table(spark, folder, "lineitem"), table(spark, folder, "part"))


def numbered_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered hourly bars, written once so that several consumers do not re-read the events."""
    return settle(number_rows(settle(hourly_bars(spark, folder))))


def numbered_brand_bars(spark: SparkSession, folder: str) -> DataFrame:
    return settle(number_rows(settle(brand_bars(spark, folder)), tile_seconds=TILE_WEEKS * 7 * 86400))
