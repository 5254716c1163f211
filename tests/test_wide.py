"""Inputs of many columns and of many categories."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import features as X
from evenkeel.plans import models as H


def test_wide_glm_equals_least_squares(spark):
    rng = np.random.default_rng(1)
    k, n = 150, 700
    x = rng.normal(1e4, 3, (n, k))
    y = x[:, :5] @ np.arange(1, 6) + rng.normal(size=n)
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(k)]).assign(y=y, g=np.where(np.arange(n) % 3 > 0, "a", None))
    df = spark.createDataFrame(pdf).repartition(3)
    got = H.gaussian_glm(df, [f"x{i}" for i in range(k)], "y", ["g"]).toPandas()
    for g in ("a", None):
        some = np.array([v == g for v in pdf.g])
        a = np.c_[np.ones(some.sum()), x[some] - 1e4]
        want, rss, *_ = np.linalg.lstsq(a, y[some], rcond=None)
        part = got[got.g.isna() if g is None else got.g == g].set_index("feature")
        assert len(part) == k
        assert np.allclose([part.coef[f"x{i}"] for i in range(k)], want[1:], atol=1e-6)
        s2 = rss[0] / (some.sum() - k - 1)
        assert np.allclose([part.stderr[f"x{i}"] for i in range(k)], np.sqrt(s2 * np.diag(np.linalg.inv(a.T @ a))[1:]), rtol=1e-5)


def test_wide_and_narrow_moments_agree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(300, 4)), columns=list("abcy")).assign(g=rng.integers(0, 3, 300), h=1.0)
    pdf.loc[5, "a"] = None
    df = spark.createDataFrame(pdf)
    want = sorted(map(tuple, H.gaussian_glm(df, list("abch"), "y", ["g"]).collect()))
    monkeypatch.setattr(H, "GRAM_INPUTS", 1)
    monkeypatch.setattr(H, "GRAM_BLOCK", 2)
    monkeypatch.setattr(H, "GRAM_BYTES", 1)
    got = sorted(map(tuple, H.gaussian_glm(df, list("abch"), "y", ["g"]).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in want], atol=1e-9)
    one = H.gaussian_glm(df, ["a", "b"], "y").collect()
    assert len(one) == 2 and H.gaussian_glm(df.where("g > 9"), ["a", "b"], "y").count() == 0


def test_plan_does_not_grow_with_the_inputs(spark):
    df = spark.range(50).select("id", *[F.rand(i).alias(f"x{i}") for i in range(400)])
    size = lambda k: H.gaussian_glm(df, [f"x{i}" for i in range(k)], "id")._jdf.queryExecution().optimizedPlan().numberedTreeString().count("\n")
    assert size(40) == size(400)


def test_dictionary_and_sparse_rows(spark):
    df = spark.createDataFrame([(1, "b", 5), (2, None, 7), (3, "a", 5), (4, "zz", None)], "id int, s string, n int")
    known = X.value_dictionary(df.where("id < 4"), ["s", "n"])
    assert sorted(map(tuple, known.collect()), key=lambda r: r[2]) == [("s", "a", 0), ("s", "b", 1), ("n", "5", 2), ("n", "7", 3)]
    got = {r.id: r.indices for r in X.sparse_one_hot(df, "id", ["s", "n"], known).collect()}
    assert got == {1: [1, 2], 2: [3], 3: [0, 2], 4: []}
    assert X.value_dictionary(df.where("id > 9"), ["s"]).count() == 0


def test_very_many_categories_are_fit(spark):
    """More categories than are ever broadcast; each label follows the category's last digit."""
    df = spark.range(120_000).select("id", F.format_string("c%06d", F.col("id") % 60_000).alias("cat"))
    df = df.withColumn("y", (F.col("id") % 10 > 4).cast("int"))
    fitted = H.fit_model(df, ["cat"], "y", "LR", {"max_iter": 5}, regression=False)
    assert fitted.encoder.width == 60_000
    table = fitted.coefficient_table(spark)
    assert table.count() == 60_000 and table.where("feature = 'cat_c000007'").first().coef > 0 > table.where("feature = 'cat_c000001'").first().coef
    assert fitted.predict(df).where((F.col("p") > 0.5) == (F.col("y") == 1)).count() == 120_000
    unseen = fitted.predict(spark.createDataFrame([("nope",), (None,)], "cat string")).collect()
    assert unseen[0].p == unseen[1].p == pytest.approx(0.5, abs=0.01)


@pytest.mark.parametrize("values", [["a", "b"], [None, None]])
def test_columns_without_values(spark, values):
    df = spark.createDataFrame([(v, float(i), i % 2) for i, v in enumerate(values * 10)], "c string, x double, y int")
    fitted = H.fit_model(df, ["c", "x"], "y", regression=False)
    assert [n for n, _ in fitted.coefficients()] == [*(f"c_{v}" for v in values if v), "x"]
