"""Scorecards of direction and magnitude predictions.

Input rows hold `p_up`, `up_pred`, `dn_pred` and the targets `y_up`, `y_dn`.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import KEYS
from barloom.functions.names import CONFIDENCE_EDGES, MAGNITUDE_EDGES
from barloom.plans.quantile import exact_quantile

MIN_CALIBRATION_ROWS = 20
HISTOGRAM_BINS = 49


def evaluation_rows(predictions: DataFrame) -> DataFrame:
    """Per row: predicted and actual side, hit, confidence, predicted and achieved move on the predicted side."""
    pred_up, actual_up = F.col("p_up") >= 0.5, F.col("y_up") >= F.col("y_dn")
    return predictions.withColumns(
        {
            "pred_up": pred_up,
            "actual_up": actual_up,
            "correct": pred_up == actual_up,
            "confidence": F.greatest(F.col("p_up"), 1.0 - F.col("p_up")),
            "pred_mag": F.when(pred_up, F.col("up_pred")).otherwise(F.col("dn_pred")),
            "achieved_mag": F.when(pred_up, F.col("y_up")).otherwise(F.col("y_dn")).cast("double"),
        }
    )


def _share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def _count(cond: Column) -> Column:
    return F.sum(cond.cast("long"))


def direction_scorecard(rows: DataFrame, keys: Iterable[str] = KEYS) -> DataFrame:
    """Counts, accuracy overall and per predicted side, base rate, best constant guess, magnitude errors."""
    up, actual = F.col("pred_up"), F.col("actual_up")
    card = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"),
        _share(F.col("correct")).alias("accuracy"),
        _share(actual).alias("base_rate_up"),
        _count(up).alias("n_pred_up"),
        _count(up & actual).alias("n_pred_up_correct"),
        _count(~up).alias("n_pred_down"),
        _count(~up & ~actual).alias("n_pred_down_correct"),
        F.avg(F.abs(F.col("up_pred") - F.col("y_up").cast("double"))).alias("mae_up"),
        F.avg(F.abs(F.col("dn_pred") - F.col("y_dn").cast("double"))).alias("mae_down"),
    )
    return card.withColumns(
        {
            "up_accuracy": F.try_divide(F.col("n_pred_up_correct").cast("double"), F.col("n_pred_up").cast("double")),
            "down_accuracy": F.try_divide(
                F.col("n_pred_down_correct").cast("double"), F.col("n_pred_down").cast("double")
            ),
            "best_constant": F.greatest(F.col("base_rate_up"), 1.0 - F.col("base_rate_up")),
        }
    )


def _bucket(x: Column, edges: tuple[float, ...]) -> Column:
    """Index of the half-open interval [edges[i], edges[i+1]) that holds x, NULL outside."""
    out = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        inside = (x >= F.lit(lo)) & (x < F.lit(hi))
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def _all_buckets(rows: DataFrame, keys: list[str], edges: tuple[float, ...]) -> DataFrame:
    """Every bucket of every key, with its bounds; from the distinct keys only."""
    dim = F.array(
        *[
            F.struct(F.lit(i).alias("bucket"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
            for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
        ]
    )
    return rows.select(*keys).distinct().select(*keys, F.inline(dim))


def confidence_buckets(rows: DataFrame, keys: Iterable[str] = KEYS) -> DataFrame:
    """Rows, share of rows and accuracy per confidence interval; empty intervals stay with NULL accuracy."""
    keys = list(keys)
    tagged = rows.withColumn("bucket", _bucket(F.col("confidence"), CONFIDENCE_EDGES))
    stats = tagged.groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("n"), _share(F.col("correct")).alias("accuracy")
    )
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    dim = _all_buckets(rows, keys, CONFIDENCE_EDGES)
    out = dim.join(stats, [*keys, "bucket"], "left").join(totals, keys)
    n = F.coalesce(F.col("n"), F.lit(0).cast("long"))
    return out.select(*keys, "lo", "hi", n.alias("n"), (n / F.col("_total")).alias("share"), "accuracy")


def calibration(rows: DataFrame, keys: Iterable[str] = KEYS, min_rows: int = MIN_CALIBRATION_ROWS) -> DataFrame:
    """Mean predicted and actual rate of up moves in ten equal intervals of `p_up`; small ones are left out."""
    edges = tuple(k * 0.1 for k in range(10)) + (float("inf"),)
    tagged = rows.withColumn("bucket", _bucket(F.col("p_up"), edges))
    stats = tagged.groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("p_up").alias("mean_p_up"),
        _share(F.col("actual_up")).alias("actual_up_rate"),
    )
    place = F.col("bucket")
    bounds = {"lo": place * 0.1, "hi": (place + 1) * 0.1}
    return stats.where(F.col("n") >= min_rows).withColumns(bounds)


def magnitude_buckets(rows: DataFrame, keys: Iterable[str] = KEYS) -> DataFrame:
    """Predicted against achieved move per interval of the predicted move, with the exact median."""
    keys = list(keys)
    tagged = rows.withColumn("bucket", _bucket(F.col("pred_mag"), MAGNITUDE_EDGES)).select(
        *keys, "bucket", "pred_mag", "achieved_mag"
    )
    got, said = F.col("achieved_mag"), F.col("pred_mag")
    stats = tagged.groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(said).alias("mean_predicted"),
        F.avg(got).alias("mean_achieved"),
        _share(got >= said).alias("hit_full"),
        _share(got >= 0.8 * said).alias("hit_80"),
    )
    median = exact_quantile(tagged, [*keys, "bucket"], "achieved_mag", 0.5, "median_achieved")
    dim = _all_buckets(rows, keys, MAGNITUDE_EDGES)
    out = dim.join(stats, [*keys, "bucket"], "left").join(median, [*keys, "bucket"], "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).drop("bucket")


def move_histogram(rows: DataFrame, keys: Iterable[str] = KEYS, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Density of the achieved move between 0 and its 99th percentile, apart for right and wrong calls.

    Every bin is listed, empty ones with 0; without any right (or wrong) call the density is NULL.
    `axis_limit` is the span a chart of predicted against achieved move needs.
    """
    keys = list(keys)
    p99 = exact_quantile(rows, keys, "achieved_mag", 0.99, "p99")
    limits = rows.groupBy(*keys).agg(F.max("pred_mag").alias("_top")).join(p99, keys)
    inside = rows.select(*keys, "correct", "achieved_mag").join(limits, keys)
    inside = inside.where(F.col("achieved_mag") <= F.col("p99"))
    width = F.col("p99") / bins
    place = F.least(F.floor(F.try_divide(F.col("achieved_mag"), width)), F.lit(bins - 1))
    none = F.lit(0).cast("long")
    counts = inside.groupBy(*keys, "correct", F.coalesce(place, none).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys, "correct").agg(F.sum("n").alias("_total"))
    calls = limits.select(*keys, "p99", "_top", F.explode(F.array(F.lit(True), F.lit(False))).alias("correct"))
    numbers = F.sequence(none, F.lit(bins - 1).cast("long"))
    every = calls.join(totals, [*keys, "correct"], "left").select("*", F.explode(numbers).alias("bin"))
    n = F.coalesce("n", none)
    return every.join(counts, [*keys, "correct", "bin"], "left").select(
        *keys,
        "correct",
        "bin",
        n.alias("n"),
        (F.col("bin") * width).alias("lo"),
        F.try_divide(n.cast("double"), F.col("_total") * width).alias("density"),
        (F.greatest("_top", "p99") * 1.05).alias("axis_limit"),
    )
