"""A direction and two magnitude models on the features, trained and applied by Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.config import MAX_RETURN_PCT, LossParams
from barloom.functions.names import MODEL_FEATURES


def training_rows(rows: DataFrame, params: LossParams = LossParams()) -> DataFrame:
    """Add the row weights of both tasks: clear moves count more for direction, large ones for magnitude."""
    up, down = F.col("y_up").cast("double"), F.col("y_dn").cast("double")
    return rows.withColumns(
        {
            "label_dir": F.col("y_dir").cast("double"),
            "label_up": up,
            "label_dn": down,
            "weight_dir": 1.0 + F.least(F.abs(up - down), F.lit(params.max_edge)),
            "weight_up": 1.0 + up,
            "weight_dn": 1.0 + down,
        }
    )


def train(
    rows: DataFrame,
    features: Iterable[str] = MODEL_FEATURES,
    params: LossParams = LossParams(),
    max_iter: int = 50,
    regularization: float = 1e-3,
) -> PipelineModel:
    """Fit on standardised rows with targets; the result can be saved and loaded as a PipelineModel."""

    def magnitude(side: str) -> LinearRegression:
        return LinearRegression(
            featuresCol="features",
            labelCol=f"label_{side}",
            weightCol=f"weight_{side}",
            predictionCol=f"raw_{side}",
            loss="huber",
            maxIter=max_iter,
            regParam=regularization,
        )

    direction = LogisticRegression(
        featuresCol="features",
        labelCol="label_dir",
        weightCol="weight_dir",
        predictionCol="said_dir",
        probabilityCol="prob_dir",
        rawPredictionCol="raw_dir",
        maxIter=max_iter,
        regParam=regularization,
    )
    stages = [VectorAssembler(inputCols=list(features), outputCol="features"), direction, magnitude("up"), magnitude("dn")]
    return Pipeline(stages=stages).fit(training_rows(rows, params))


def score(model: PipelineModel, rows: DataFrame, cap: float = MAX_RETURN_PCT) -> DataFrame:
    """Append `logit`, `p_up`, `up_pred` and `dn_pred` (both in [0, cap])."""
    made = ["features", "prob_dir", "raw_dir", "said_dir", "raw_up", "raw_dn"]

    def capped(name: str):
        return F.least(F.greatest(F.col(name), F.lit(0.0)), F.lit(cap))

    scored = model.transform(rows).withColumns(
        {
            "logit": vector_to_array("raw_dir")[1],
            "p_up": vector_to_array("prob_dir")[1],
            "up_pred": capped("raw_up"),
            "dn_pred": capped("raw_dn"),
        }
    )
    return scored.drop(*made)


def score_with(
    predict: Callable[[pd.DataFrame], pd.DataFrame], rows: DataFrame, features: Iterable[str] = MODEL_FEATURES
) -> DataFrame:
    """Apply any model that maps a feature frame to `p_up`, `up_pred`, `dn_pred`, one Arrow batch at a time."""
    features = list(features)
    schema = T.StructType(list(rows.schema.fields))
    for name in ("p_up", "up_pred", "dn_pred"):
        schema = schema.add(name, "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = predict(batch[features])
            yield batch.assign(**{name: out[name].to_numpy() for name in ("p_up", "up_pred", "dn_pred")})

    return rows.mapInPandas(run, schema)


def with_confidence(scored: DataFrame) -> DataFrame:
    """Confidence in the predicted side and the magnitude predicted for it."""
    return scored.withColumns(
        {
            "confidence": F.greatest(F.col("p_up"), 1.0 - F.col("p_up")),
            "magnitude": F.when(F.col("p_up") >= 0.5, F.col("up_pred")).otherwise(F.col("dn_pred")),
        }
    )
