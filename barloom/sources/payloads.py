"""Candle payloads in files, one folder per symbol and 7-day chunk: as one table and as a stream.

Folders are partition columns, so a plan has one scan however many symbols there are, symbols and chunks that a reader
does not ask for are not opened, and tasks are cut by files and bytes, not by symbol.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalar import local_seconds
from barloom.sources.bars import BAR_COLUMNS, bars_from_payloads

CHUNK_DAYS = 7
SCHEMA = "body string, symbol string, chunk date"


def chunk_of(day: Column, days: int = CHUNK_DAYS) -> Column:
    """First day of the chunk a date lies in; chunks are counted from 1970-01-01."""
    return F.date_from_unix_date((F.floor(F.unix_date(day) / days) * days).cast("int"))


def to_payloads(bars: DataFrame, days: int = CHUNK_DAYS) -> DataFrame:
    """(symbol, chunk, body): one payload per symbol and chunk, numbers as text, candles in time order.

    A chunk holds what its days allow, so a payload is bounded however long a series is.
    """
    numbers = [F.col(c).cast("string").alias(c) for c in BAR_COLUMNS]
    candle = F.struct(local_seconds(F.col("ts")).alias("time"), *numbers)
    grouped = bars.groupBy("symbol", chunk_of(F.to_date("ts"), days).alias("chunk")).agg(F.sort_array(F.collect_list(candle)).alias("result"))
    return grouped.select("symbol", "chunk", F.to_json(F.struct(F.lit(True).alias("success"), "result")).alias("body"))


def write_payloads(payloads: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One line per payload below `symbol=.../chunk=...`; rows are spread by both, so a hot symbol has many writers."""
    payloads.select("body", "symbol", "chunk").repartition("symbol", "chunk").write.mode(mode).partitionBy("symbol", "chunk").text(path)


def _bars(lines: DataFrame, symbols: Iterable[str] | None, start: dt.datetime | None, end: dt.datetime | None, time_zone: str | None, days: int) -> DataFrame:
    if symbols is not None:
        lines = lines.where(F.col("symbol").isin(list(symbols)))
    # the wall clock of a zone is at most a day off the chunk's
    slack = dt.timedelta(days=0 if time_zone is None else 1)
    if start is not None:
        lines = lines.where(F.col("chunk") > F.lit((start - slack - dt.timedelta(days=days)).date()))
    if end is not None:
        lines = lines.where(F.col("chunk") <= F.lit((end + slack).date()))
    bars = bars_from_payloads(lines, "body", time_zone).drop("pos", "chunk")
    for at, inside in ((start, F.col("ts") >= F.lit(start).cast("timestamp_ntz")), (end, F.col("ts") < F.lit(end).cast("timestamp_ntz"))):
        if at is not None:
            bars = bars.where(inside)
    return bars


def read_payloads(
    spark: SparkSession, path: str, symbols: Iterable[str] | None = None, start: dt.datetime | None = None,
    end: dt.datetime | None = None, time_zone: str | None = None, days: int = CHUNK_DAYS,
) -> DataFrame:
    """Bars of all or some symbols with start <= ts < end; folders outside are not opened."""
    return _bars(spark.read.schema(SCHEMA).text(path), symbols, start, end, time_zone, days)


def stream_payloads(
    spark: SparkSession, path: str, symbols: Iterable[str] | None = None, start: dt.datetime | None = None,
    end: dt.datetime | None = None, time_zone: str | None = None, days: int = CHUNK_DAYS, files_per_batch: int = 1000,
) -> DataFrame:
    """The same bars as a stream of the files that are there and those that come."""
    lines = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).text(path)
    return _bars(lines, symbols, start, end, time_zone, days)
