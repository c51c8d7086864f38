"""Written tables, their rounds and what they leave behind."""

import os

import pytest
from pyspark.sql import functions as F

from barloom.plans.settle import CLEAN_SHUFFLES, Rounds, scratch_path, settle, shared_folder, shuffles_removed


def folders(spark):
    place = shared_folder(spark).removeprefix("file:")
    return {x for x in os.listdir(place) if x.startswith("settled-")} if os.path.exists(place) else set()


def test_rounds_keep_the_last_table_only(spark):
    before, rounds = folders(spark), Rounds()
    df = spark.range(5).toDF("x")
    for k in range(4):
        df = rounds.settle(df.select((F.col("x") + 1).alias("x")))
        assert len(folders(spark) - before) == 1
    assert sorted(r["x"] for r in df.collect()) == [4, 5, 6, 7, 8]


def test_settings_are_restored(spark):
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    with pytest.raises(ZeroDivisionError), shuffles_removed(spark):
        assert spark.conf.get(CLEAN_SHUFFLES) == "true"
        1 / 0
    settle(spark.range(3))
    assert spark.conf.get(CLEAN_SHUFFLES, "false") == before


def test_settled_rows_survive_their_source(spark):
    path = scratch_path(spark, "source")
    spark.range(100).repartition(4).write.parquet(path)
    kept = settle(spark.read.parquet(path).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    spark.range(0).write.mode("overwrite").parquet(path)
    assert sum(r["n"] for r in kept.collect()) == 100
