"""Bars and de-duplication over Structured Streaming; `indicators.py` and `context.py` keep features of bars."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.config import KEYS

BATCH = "batch_id"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_bars(
    ticks: DataFrame, price: str, volume: str, order: Iterable[str], width: str, lateness: str,
    keys: tuple[str, ...] = KEYS, ts: str = "ts",
) -> DataFrame:
    """Bars of a tick stream; state of a bar is dropped once the watermark has passed it."""
    place = F.struct(*order)
    windowed = ticks.withWatermark(ts, lateness).groupBy(*keys, F.window(ts, width).alias("_w"))
    return windowed.agg(
        F.min_by(price, place).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, place).alias("close"),
        F.sum(volume).alias("volume"),
    ).select(*keys, F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")


def first_seen(candles: DataFrame, lateness: str, keys: tuple[str, ...] = KEYS, ts: str = "ts") -> DataFrame:
    """One row per (key, ts): the first that arrives; later copies within the lateness are dropped."""
    return candles.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([*keys, ts])


@contextmanager
def _state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which operators with several state variables need."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain the stream and keep every update with its batch number in a table under `path`."""

    def keep(batch: DataFrame, number: int) -> None:
        # A batch that is retried replaces its own folder, so it counts once.
        batch.withColumn(BATCH, F.lit(number)).write.mode("overwrite").parquet(f"{path}/part={number}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    with _state_in_rocksdb(stream.sparkSession):
        query = writer.trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()


def latest(spark: SparkSession, path: str, keys: Iterable[str]) -> DataFrame:
    """Last update of every key in a table written by `run_updates`."""
    rows = spark.read.parquet(path).drop("part")
    keys = list(keys)
    rest = [x for x in rows.columns if x not in (*keys, BATCH)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("_r")).select(*keys, "_r.*")
