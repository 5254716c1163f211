"""Forests over binned rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.plans import forests
from evenkeel.plans.models import fit_model


def _noisy(spark, n=4000):
    rows = spark.range(n).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"), F.concat(F.lit("c"), F.col("id") % 3).alias("c"), F.rand(3).alias("e"))
    y = ((F.col("a") > 0.5) != (F.col("b") > 0.5)) != (F.col("e") < 0.1)
    return rows.withColumn("y", y.cast("int")).withColumn("v", 10 * F.col("a") + F.when(F.col("c") == "c1", 5).otherwise(0)).cache()


@pytest.mark.parametrize("regression", [False, True])
def test_a_forest_reads_its_rows_a_few_times_whatever_its_depth(spark, regression):
    df = _noisy(spark)
    sc = spark.sparkContext
    group = f"deep-{regression}"
    sc.setJobGroup(group, group)
    params = {"n_estimators": 40, "max_depth": 30}
    fitted = fit_model(df, ["a", "b", "c"], "v" if regression else "y", "RF", params, regression=regression, seed=3)
    assert len(sc.statusTracker().getJobIdsForGroup(group)) <= 36
    sc.setLocalProperty("spark.jobGroup.id", None)
    got = fitted.predict_all(df).select("a", "b", "c", "y", "v", "p", "pred").toPandas()
    if regression:
        assert np.corrcoef(got.p, got.v)[0, 1] > 0.97
        assert got.p.mean() == pytest.approx(got.v.mean(), rel=0.01)
    else:
        truth = ((got.a > 0.5) != (got.b > 0.5)).astype(int)
        inside = (abs(got.a - 0.5) > 0.05) & (abs(got.b - 0.5) > 0.05)
        assert ((got.p > 0.5) == (truth == 1))[inside].mean() > 0.93
        assert ((got.p > 0.5) == (got.pred == 1)).mean() > 0.999


def test_a_tree_of_all_inputs_splits_where_the_gain_is_greatest():
    bins = np.array([[i, j] for i in range(4) for j in range(4)], dtype=np.uint8)
    y = (bins[:, 0] > 1) & (bins[:, 1] > 2)
    got = forests.grow(bins, np.stack([~y, y], axis=1) * 7.0, 5, False, 2, np.random.default_rng(0))
    model = forests.BinnedForest([np.arange(3.0)] * 2, [{**got, "leaf": got["sums"] / got["sums"].sum(axis=1, keepdims=True)}], False)
    assert (model.scores(bins)[:, 1] == y).all() and len(got["input"]) == 5
    assert forests.grow(bins, np.stack([~y, y], axis=1) * 7.0, 0, False, 2, np.random.default_rng(0))["input"].tolist() == [-1]


def test_cells_hold_every_row_and_bags_their_expected_weight(spark):
    rows = spark.range(6000).select(F.array((F.col("id") % 5).cast("double"), (F.col("id") % 2).cast("double")).alias("x"), (F.col("id") % 3).cast("double").alias("y")).repartition(3)
    edges = forests.thresholds(rows, 0, 2)
    assert [e.tolist() for e in edges] == [[0.5, 1.5, 2.5, 3.5], [0.5]]
    counts = forests.cell_counts(rows, edges, 3).collect()
    assert len(counts) == 10 and all(list(r.v) == [200.0] * 3 for r in counts)
    bags = forests.bagged_sums(rows, edges, 30, 1.0, 5).toPandas()
    v = np.stack(bags["v"].to_numpy())
    assert len(bags) == 300 and v[:, 0].mean() == pytest.approx(600, rel=0.02) and v[:, 0].std() == pytest.approx(np.sqrt(600), rel=0.2)
    assert v[:, 2].mean() == pytest.approx(400, rel=0.02) and abs(v[:, 1].mean()) < 5


def test_many_cells_are_left_to_sparks_forest(spark, monkeypatch):
    monkeypatch.setattr(forests, "CELLS", 50)
    fitted = fit_model(_noisy(spark, 500), ["a", "b"], "y", "RF", {"n_estimators": 5, "max_depth": 4}, regression=False, seed=3)
    assert not isinstance(fitted.model, forests.BinnedForest)
