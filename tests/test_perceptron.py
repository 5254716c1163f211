"""The distributed perceptron."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.plans import perceptron
from evenkeel.plans.models import fit_model


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    layers = [3, 5, 4, 3]
    x, y, w = rng.normal(size=(20, 3)), rng.integers(0, 3, 20), perceptron.start(layers, 2)
    g = perceptron.loss_and_gradient(x, y, w, layers)[1]
    for i in range(0, len(w), 5):
        step = np.zeros(len(w))
        step[i] = 1e-6
        up, down = (perceptron.loss_and_gradient(x, y, w + s, layers)[0] for s in (step, -step))
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_minimise_finds_the_valley_of_a_curved_function():
    def rosenbrock(w):
        a, b = w
        return float((1 - a) ** 2 + 100 * (b - a * a) ** 2 + 1), np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    assert perceptron.minimise(rosenbrock, np.array([-1.2, 1.0]), 200) == pytest.approx([1.0, 1.0], abs=1e-2)


def test_every_row_is_fit_and_scored_in_any_partitioning(spark):
    df = spark.range(2000).coalesce(2).select("id", (F.rand(1) * 2 - 1).alias("a"), (F.rand(2) * 2 - 1).alias("b"))
    df = df.withColumn("y", F.when(F.col("a") * F.col("b") > 0, 1).when(F.col("a") > 0, 2).otherwise(0)).cache()
    params = {"hidden_layer_sizes": (8,), "max_iter": 30}
    fits = [fit_model(part, ["a", "b"], "y", "MLP", params, regression=False, seed=1) for part in (df, df.repartition(7))]
    assert isinstance(fits[0].model, perceptron.Perceptron) and list(fits[0].model.layers) == [2, 8, 3]
    for fitted in fits:
        got = fitted.predict_all(df).select("y", "pred", "probas").toPandas()
        assert (got.y == got.pred).mean() > 0.7 and len(got) == 2000
        assert np.allclose(np.stack(got.probas).sum(axis=1), 1)
