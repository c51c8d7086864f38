"""Chronological purged split, standardisation and training sequences."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.config import KEYS, LossParams, SplitParams
from barloom.functions.names import MODEL_FEATURES
from barloom.functions.scalar import pct
from barloom.plans.blocks import POS, TOTAL, in_blocks


def with_split(valid: DataFrame, params: SplitParams = SplitParams()) -> DataFrame:
    """Add `train_end`, `val_end` and `split` (train / val / test, NULL when purged or without a full window).

    `n` counts all bars of a series; the labelled ones are the first n - lookahead.
    """
    n = F.col(TOTAL) - params.lookahead
    rn = F.col(POS)
    bounds = valid.withColumns(
        {
            "train_end": F.floor(n * F.lit(params.train_frac)),
            "val_end": F.floor(n * F.lit(params.train_frac + params.val_frac)),
        }
    )
    train, val = F.col("train_end"), F.col("val_end")
    split = (
        F.when(rn < params.window - 1, None)
        .when(rn < train - params.lookahead, "train")
        .when((rn >= train) & (rn < val - params.lookahead), "val")
        .when(rn >= val, "test")
    )
    return bounds.withColumn("split", split)


def split_bounds(bars: DataFrame, params: SplitParams = SplitParams(), keys: Iterable[str] = KEYS) -> DataFrame:
    """One row per series with its labelled length and the two split positions."""
    per_key = bars.groupBy(*keys).agg(F.greatest(F.max(TOTAL) - params.lookahead, F.lit(0)).alias("labelled"))
    return per_key.withColumns(
        {
            "train_end": F.floor(F.col("labelled") * F.lit(params.train_frac)),
            "val_end": F.floor(F.col("labelled") * F.lit(params.train_frac + params.val_frac)),
        }
    )


def split_summary(split: DataFrame, keys: Iterable[str] = KEYS, big_move: float = 1.0) -> DataFrame:
    """Windows, up / down counts and shares, mean larger move and number of big moves per split."""
    move = F.greatest("y_up", "y_dn").cast("double")
    ups = F.sum("y_dir").cast("long")
    rows = F.count(F.lit(1))
    agg = split.where(F.col("split").isNotNull()).groupBy(*keys, "split")
    return agg.agg(
        rows.alias("windows"),
        ups.alias("up_bars"),
        (rows - ups).alias("down_bars"),
        pct(ups, rows).alias("up_pct"),
        pct(rows - ups, rows).alias("down_pct"),
        F.avg(move).alias("mean_move"),
        F.sum((move > big_move).cast("long")).alias("big_moves"),
    )


def scaler_stats(
    split: DataFrame, features: Iterable[str] = MODEL_FEATURES, keys: Iterable[str] = KEYS
) -> DataFrame:
    """Mean and population deviation of each feature over the rows before `train_end`; 0 becomes 1.

    A partial aggregate: one row per series and task reaches the exchange.
    """
    aggs = []
    for name in features:
        spread = F.stddev_pop(name)
        aggs.append(F.avg(name).alias(f"mean_{name}"))
        aggs.append(F.when(spread == 0.0, 1.0).otherwise(spread).alias(f"scale_{name}"))
    return split.where(F.col(POS) < F.col("train_end")).groupBy(*keys).agg(*aggs)


def standardize(
    split: DataFrame,
    stats: DataFrame | None = None,
    features: Iterable[str] = MODEL_FEATURES,
    keys: Iterable[str] = KEYS,
) -> DataFrame:
    """Scale the features by train-only statistics; missing results become 0.

    The statistics (one row per series) are joined without a hint: they are broadcast when their size
    is under the session's threshold and shuffled otherwise, where skewed series are split at run time.
    """
    features, keys = list(features), list(keys)
    stats = scaler_stats(split, features, keys) if stats is None else stats
    joined = split.join(stats, keys, "left")
    scaled = {
        name: F.coalesce(
            F.try_divide(F.col(name) - F.col(f"mean_{name}"), F.col(f"scale_{name}")), F.lit(0.0)
        )
        for name in features
    }
    return joined.withColumns(scaled).drop(*[f"{tag}_{name}" for tag in ("mean", "scale") for name in features])


def sequences(
    rows: DataFrame, features: Iterable[str] = MODEL_FEATURES, window: int = 60, keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """Add `sequence`: the feature vectors of the last `window` bars, oldest first, where that many exist."""
    b = in_blocks(rows, back=window - 1, keys=keys)
    vector = "array(" + ", ".join(f"float({f})" for f in features) + ")"
    over = b.window(f"rows between {window - 1} preceding and current row")
    b = b.with_columns({"sequence": f"collect_list({vector}) {over}"})
    return b.core().where(F.size("sequence") == window)


def with_loss(scored: DataFrame, params: LossParams = LossParams()) -> DataFrame:
    """Row losses from `logit`, `up_pred`, `dn_pred` and the targets.

    Direction: cross-entropy weighted 1 + min(|up - down|, max_edge); magnitude: Huber weighted 1 + target.
    """
    x, y = F.col("logit"), F.col("y_dir").cast("double")
    up, down = F.col("y_up").cast("double"), F.col("y_dn").cast("double")
    entropy = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    weight = 1.0 + F.least(F.abs(up - down), F.lit(params.max_edge))

    def huber(pred: str, actual):
        gap = F.abs(F.col(pred) - actual)
        d = params.huber_delta
        return F.when(gap <= d, 0.5 * gap * gap).otherwise(d * (gap - 0.5 * d)) * (1.0 + actual)

    out = scored.withColumns(
        {"loss_dir": entropy * weight, "loss_up": huber("up_pred", up), "loss_dn": huber("dn_pred", down)}
    )
    total = params.direction_weight * F.col("loss_dir") + params.magnitude_weight * (
        F.col("loss_up") + F.col("loss_dn")
    )
    return out.withColumn("loss", total)


def validation_metrics(
    scored: DataFrame, params: LossParams = LossParams(), keys: Iterable[str] = KEYS
) -> DataFrame:
    """Mean loss and its parts, direction accuracy at logit 0, and the mean of both magnitude errors."""
    rows = with_loss(scored, params)
    hit = (F.col("logit") >= 0.0) == (F.col("y_dir") >= 0.5)
    error = F.abs(F.col("up_pred") - F.col("y_up").cast("double")) + F.abs(
        F.col("dn_pred") - F.col("y_dn").cast("double")
    )
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(name).alias(name) for name in ("loss_dir", "loss_up", "loss_dn", "loss")],
        F.avg(hit.cast("double")).alias("direction_accuracy"),
        (F.avg(error) / 2.0).alias("magnitude_mae"),
    )


