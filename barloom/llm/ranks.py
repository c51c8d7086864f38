"""Position of every row in a total order, without a window over all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.plans.settle import settle


def global_rank(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Adds `name`, 0-based. Rows are range-sorted and written; a row's rank is its place in its partition plus the
    rows of the partitions before it. Only one count per sort partition reaches the driver."""
    placed = settle(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts = [0, *accumulate(n for _, n in counts)]
    lookup = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(counts, starts, strict=False)], "_part long, _start long")
    # one row per sort partition: the broadcast is bounded by spark.sql.shuffle.partitions
    joined = placed.withColumn("_part", part).join(F.broadcast(lookup), "_part")
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(name, F.col("_start") + within).drop("_part", "_start", "_place")
