"""The jointly fitted predictor against a plain minimiser and the loss it minimises."""

import numpy as np
import pandas as pd
import pytest

from barloom.config import LossParams
from barloom.operators import dataset, joint
from barloom.operators.joint import JointModel, fit_joint, joint_gradient, score_joint

FEATURES = ("a", "b", "c")


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 3))
    up = np.clip(0.8 + 0.5 * x[:, 0] + rng.normal(0, 0.4, 1500), 0, 5)
    up[::50] = 5.0  # beyond the quadratic part
    dn = np.clip(0.6 - 0.4 * x[:, 1] + rng.normal(0, 0.4, 1500), 0, 5)
    return pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y_up": up, "y_dn": dn, "y_dir": (up >= dn).astype(int)})


def mean_loss(frame, weights, ridge, params=LossParams()):
    x = np.column_stack([frame[list(FEATURES)].to_numpy(), np.ones(len(frame))])
    logit, up, dn = (x @ np.array(w) for w in weights)
    edge = 1 + np.minimum(np.abs(frame["y_up"] - frame["y_dn"]), params.max_edge)
    entropy = (np.logaddexp(0, logit) - logit * frame["y_dir"]) * edge

    def huber(said, y):
        gap = np.abs(said - y)
        return np.where(gap <= 1.5, gap * gap / 2, 1.5 * (gap - 0.75)) * (1 + y)

    total = params.direction_weight * entropy + params.magnitude_weight * (huber(up, frame["y_up"]) + huber(dn, frame["y_dn"]))
    return total.mean() + ridge / 2 * sum(v * v for w in weights for v in w[:-1])


def test_the_minimum_is_found(spark, frame):
    model = fit_joint(spark.createDataFrame(frame).repartition(7), FEATURES, ridge=1e-2)
    best = mean_loss(frame, model.weights, 1e-2)
    assert model.rounds < 20
    rng = np.random.default_rng(1)
    for _ in range(200):  # no way down
        moved = np.array(model.weights) + rng.normal(size=(3, 4)) * 10.0 ** rng.uniform(-5, 0)
        assert mean_loss(frame, moved, 1e-2) >= best - 1e-12
    for row in joint_gradient(model, spark.createDataFrame(frame)).collect():
        assert abs(row["gradient"]) < 1e-9 and row["rows"] == 1500


def test_layout_and_start_do_not_matter(spark, frame):
    df = spark.createDataFrame(frame)
    a, b = fit_joint(df.repartition(1), FEATURES), fit_joint(df.repartition(11), FEATURES)
    np.testing.assert_allclose(a.weights, b.weights, rtol=1e-7, atol=1e-9)
    # targets far from 0: the first steps lie where no curvature is
    far = df.selectExpr("a", "b", "c", "y_dir", "y_up + 40 as y_up", "y_dn + 70 as y_dn")
    model = fit_joint(far, FEATURES)
    assert max(abs(r["gradient"]) for r in joint_gradient(model, far).collect()) < 1e-8


def test_scores_and_saved_model(spark, frame):
    df = spark.createDataFrame(frame)
    model = fit_joint(df, FEATURES)
    again = JointModel.from_json(model.to_json())
    assert again == model
    got = score_joint(again, df).toPandas()
    x = np.column_stack([got[list(FEATURES)], np.ones(len(got))])
    np.testing.assert_allclose(got["p_up"], 1 / (1 + np.exp(-x @ np.array(model.weights[0]))), rtol=1e-12)
    np.testing.assert_allclose(got["up_pred"], np.clip(x @ np.array(model.weights[1]), 0, 5), atol=1e-12)
    assert ((got["p_up"] >= 0.5) == (got["y_dir"] == 1)).mean() > 0.75
    scored = score_joint(model, df.selectExpr("*", "'s' as symbol"))
    assert dataset.validation_metrics(scored).first()["direction_accuracy"] > 0.75


def test_no_rows(spark, frame):
    with pytest.raises(ValueError):
        fit_joint(spark.createDataFrame(frame).limit(0), FEATURES)
    assert joint.HEADS == ("logit", "up_pred", "dn_pred")
