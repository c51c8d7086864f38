"""Cut lineage with a table written to the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's own switch for removing an execution's shuffle files as soon as it ends.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`, else the one set on the context, else (tests) a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    local = os.path.join(tempfile.gettempdir(), f"barloom-{spark.sparkContext.applicationId}")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir()


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Scratch tables live as long as the application: results that read them may still be open."""
    place, files = _place(spark, path)
    files.deleteOnExit(place)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return path


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind: its rows are read from the written table from then on."""
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_path(spark, "settled")
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def settle(df: DataFrame) -> DataFrame:
    """Write `df` once and read it back: several consumers then share one computation, still column-pruned."""
    return _written(df)[0]


class Rounds:
    """Settled tables of an iteration in which a round reads the round before it only: once a round is written, the
    one before is removed."""

    def __init__(self) -> None:
        self._last: str | None = None

    def settle(self, df: DataFrame) -> DataFrame:
        out, path = _written(df)
        if self._last is not None:
            place, files = _place(df.sparkSession, self._last)
            files.delete(place, True)
        self._last = path
        return out
