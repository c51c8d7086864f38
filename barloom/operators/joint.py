"""Linear predictor of direction and both magnitudes, fitted by minimising the two-task loss itself.

Every round is one pass over the written training rows: a task sums the loss, gradient and curvature of its rows for
all three outputs, the sums are added up in Spark, and the driver solves three systems of the size of the feature
list. An output whose loss a Newton step would raise takes the step of a quadratic that lies above its loss instead,
which never does.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.config import MAX_RETURN_PCT, LossParams
from barloom.functions.names import MODEL_FEATURES
from barloom.plans.settle import settle

HEADS = ("logit", "up_pred", "dn_pred")
TARGETS = ("y_dir", "y_up", "y_dn")


@dataclass(frozen=True)
class JointModel:
    """Weights of each head (`HEADS`) on the features and, last, on the constant 1."""

    features: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]
    ridge: float
    params: LossParams
    rounds: int = 0

    def to_json(self) -> str:
        fields = {"features": self.features, "weights": self.weights, "ridge": self.ridge, "rounds": self.rounds}
        return json.dumps(fields | {"params": self.params.__dict__})

    @classmethod
    def from_json(cls, text: str) -> JointModel:
        d = json.loads(text)
        weights = tuple(tuple(w) for w in d["weights"])
        return cls(tuple(d["features"]), weights, d["ridge"], LossParams(**d["params"]), d["rounds"])


def _row_weights(y: np.ndarray, params: LossParams) -> np.ndarray:
    """Weights of the rows for the three heads; y holds direction, up and down."""
    edge = 1.0 + np.minimum(np.abs(y[:, 1] - y[:, 2]), params.max_edge)
    half = params.magnitude_weight
    return np.stack([params.direction_weight * edge, half * (1.0 + y[:, 1]), half * (1.0 + y[:, 2])], axis=1)


def _losses(said: np.ndarray, y: np.ndarray, params: LossParams) -> np.ndarray:
    x, d = said[:, 0], params.huber_delta
    entropy = np.maximum(x, 0.0) - x * y[:, 0] + np.log1p(np.exp(-np.abs(x)))
    gap = np.abs(said[:, 1:] - y[:, 1:])
    huber = np.where(gap <= d, 0.5 * gap * gap, d * (gap - 0.5 * d))
    return np.column_stack([entropy, huber]) * _row_weights(y, params)


def _slopes(said: np.ndarray, y: np.ndarray, params: LossParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second derivatives of the row losses by the heads' outputs, and second ones of quadratics above them."""
    p = 1.0 / (1.0 + np.exp(-said[:, 0]))
    gap, d = said[:, 1:] - y[:, 1:], params.huber_delta
    w = _row_weights(y, params)
    first = np.column_stack([p - y[:, 0], np.clip(gap, -d, d)]) * w
    second = np.column_stack([p * (1.0 - p), (np.abs(gap) <= d).astype(float)]) * w
    above = np.column_stack([np.full(len(p), 0.25), d / np.maximum(np.abs(gap), d)]) * w
    return first, second, above


def _summed(data: DataFrame, width: int, measure) -> np.ndarray:
    """Sum over all rows of `measure` (features with constant, targets -> vector): a vector per task, added in Spark."""

    def part(batches):
        total = None
        for batch in batches:
            cells = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            x, y = np.column_stack([cells[:, :width], np.ones(len(cells))]), cells[:, width:]
            values = measure(x, y)
            total = values if total is None else total + values
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["pos", "v"])

    sums = data.mapInArrow(part, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect()  # a few hundred numbers
    out = np.zeros(len(sums))
    for r in sums:
        out[r["pos"]] = r["v"]
    return out


def fit_joint(
    rows: DataFrame, features: Iterable[str] = MODEL_FEATURES, params: LossParams = LossParams(), ridge: float = 1e-3,
    tolerance: float = 1e-10, most_rounds: int = 100,
) -> JointModel:
    """The minimum of the mean two-task loss plus ridge / 2 times the squared weights (not that of the constant).

    Rows need the features and `y_dir`, `y_up`, `y_dn`, none of them NULL. Newton steps; the loss is convex, so the
    result is the only one. Raises if the gradient is not below the tolerance after `most_rounds` passes.
    """
    features = tuple(features)
    width, size = len(features), len(features) + 1
    data = settle(rows.select(*[F.col(c).cast("double") for c in (*features, *TARGETS)]))
    n = data.count()
    if not n:
        raise ValueError("no training rows")
    penalty = np.append(np.full(width, ridge), 0.0)
    w = np.zeros((3, size))

    def measured(w: np.ndarray):
        def measure(x, y):
            said = x @ w.T
            first, *bends = _slopes(said, y, params)
            curves = [(x * bend[:, [h]]).T @ x for bend in bends for h in range(3)]
            return np.concatenate([_losses(said, y, params).sum(axis=0), (first.T @ x).ravel(), *(c.ravel() for c in curves)])

        sums = _summed(data, width, measure) / n
        loss = sums[:3] + 0.5 * (penalty * w * w).sum(axis=1)
        slope = sums[3 : 3 + 3 * size].reshape(3, size) + penalty * w
        return loss, slope, sums[3 + 3 * size :].reshape(2, 3, size, size) + np.diag(penalty)

    # a tiny multiple of the identity keeps a head without curvature (all gaps beyond delta) solvable
    solved = lambda curves, slopes: np.stack([np.linalg.solve(c + 1e-10 * np.eye(size), s) for c, s in zip(curves, slopes, strict=True)])
    loss, slope, curve = measured(w)
    for done in range(1, most_rounds + 1):
        if np.abs(slope).max() < tolerance:
            return JointModel(features, tuple(map(tuple, w.tolist())), ridge, params, done)
        steps = solved(curve[0], slope)
        tried = measured(w - steps)
        worse = ~(tried[0] <= loss + 1e-15 * np.abs(loss))
        if worse.any():
            steps[worse] = solved(curve[1], slope)[worse]
            tried = measured(w - steps)
        w, (loss, slope, curve) = w - steps, tried
    raise ValueError(f"gradient {np.abs(slope).max():.3g} after {most_rounds} rounds")


def _said(model: JointModel, head: int):
    out = F.lit(model.weights[head][-1])
    for name, weight in zip(model.features, model.weights[head], strict=False):
        out = out + F.lit(weight) * F.col(name)
    return out


def score_joint(model: JointModel, rows: DataFrame, cap: float = MAX_RETURN_PCT) -> DataFrame:
    """Append `logit`, `p_up`, `up_pred` and `dn_pred` (both in [0, cap]), as column expressions."""
    bounded = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(cap))
    scored = rows.withColumns({"logit": _said(model, 0), "up_pred": bounded(_said(model, 1)), "dn_pred": bounded(_said(model, 2))})
    return scored.withColumn("p_up", 1.0 / (1.0 + F.exp(-F.col("logit"))))


def joint_gradient(model: JointModel, rows: DataFrame) -> DataFrame:
    """(head, feature, gradient, rows): slope of the penalised mean loss by each weight, in column expressions of their
    own: all zero at the minimum."""
    params, d = model.params, model.params.huber_delta
    y = [F.col(c).cast("double") for c in TARGETS]
    edge = 1.0 + F.least(F.abs(y[1] - y[2]), F.lit(params.max_edge))
    slopes = [params.direction_weight * edge * (1.0 / (1.0 + F.exp(-_said(model, 0))) - y[0])]
    for head in (1, 2):
        gap = _said(model, head) - y[head]
        slopes.append(params.magnitude_weight * (1.0 + y[head]) * F.least(F.greatest(gap, F.lit(-d)), F.lit(d)))
    sloped = rows.select(*model.features, F.lit(1.0).alias("constant"), *[s.alias(h) for s, h in zip(slopes, HEADS, strict=True)])
    names = (*model.features, "constant")
    means = sloped.agg(F.count(F.lit(1)).alias("rows"), *[F.avg(F.col(h) * F.col(f)).alias(f"{h}:{f}") for h in HEADS for f in names])
    cells = []
    for h, head in enumerate(HEADS):
        for f, name in enumerate(names):
            pull = 0.0 if name == "constant" else model.ridge * model.weights[h][f]
            cells.append(F.struct(F.lit(head).alias("head"), F.lit(name).alias("feature"), (F.col(f"`{head}:{name}`") + F.lit(pull)).alias("gradient")))
    return means.select("rows", F.inline(F.array(*cells))).select("head", "feature", "gradient", "rows")
