"""Fits of many runs at once against conditions of optimality and fits one by one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evenkeel.operators.balance import METHODS, balanced_times
from evenkeel.operators.splits import stratified_kfold
from evenkeel.plans import batched as B
from evenkeel.plans.models import fit_model
from evenkeel.plans.runs import estimate_associations


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(5)
    n = 900
    pdf = pd.DataFrame({
        "id": np.arange(n), "a": rng.normal(1000, 20, n), "b": rng.normal(size=n), "g": rng.choice(["u", "v", "w"], n),
        "site": rng.choice(["s", "t"], n), "flat": np.full(n, 3.0),
    })
    z = (pdf.a - 1000) / 20 + (pdf.g == "u") - 0.5 * (pdf.site == "s")
    pdf["y"] = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    pdf["kind"] = rng.choice(["k0", "k1"], n)
    pdf.loc[z > 0.8, "kind"] = "k2"
    pdf["value"] = 3 * z + rng.normal(size=n)
    pdf["lbl"] = np.where(pdf.y == 1, "yes", "no")
    return spark.createDataFrame(pdf)


def stored_table(df, label, folds):
    base = df.withColumn("__y", F.col(label).cast("double"))
    return stratified_kfold(base.withColumn("all_rows", F.lit(0)), "all_rows", "id", folds).withColumn("fold", F.col("fold").cast("int")).withColumn("__set", F.lit(None).cast("string"))


def slope_at(pdf, names, coefs, intercept_of, ridge, loss, y):
    """Gradient of the penalised loss on standardised inputs at the fitted coefficients, the
    intercept being the best for them."""
    x = np.stack([(pdf[c] - pdf[c].mean()) / (pdf[c].std(ddof=0) or 1) if c in pdf else (pdf[c.split("_")[0]] == c.split("_", 1)[1]).astype(float) for c in names], axis=1)
    z0, b = x @ coefs, 0.0
    for _ in range(100):
        r, w = intercept_of(z0 + b, y)
        b -= r.sum() / w.sum()
    r, _ = intercept_of(z0 + b, y)
    return x.T @ r + ridge * coefs


def logistic_parts(z, y):
    p = 1 / (1 + np.exp(-z))
    return p - y, p * (1 - p)


@pytest.mark.parametrize("penalty,c", [("l2", 1.0), (None, 1.0), ("l2", 0.01)])
def test_logistic_runs_are_optimal(mixed, penalty, c):
    stored = stored_table(mixed, "y", 3)
    feats = [("a", "b"), ("a", "g", "flat"), ("g", "site")]
    plan = B.layout(stored, ["a", "b", "g", "flat", "site"])
    runs = [B.Run(str(i), f, "baseline", t) for i, f in enumerate(feats) for t in range(3)]
    fits = B.fit_runs(stored, plan, runs, "LR", {"penalty": penalty, "C": c}, False, 2)
    pdf = stored.toPandas()
    for i, run in enumerate(runs):
        train = pdf[pdf.fold != run.trial]
        names, coefs = zip(*fits.coefficients(i))
        assert fits.problems[i].n == len(train)
        g = slope_at(train, names, np.array(coefs), logistic_parts, 0.0 if penalty is None else 1 / c, "logistic", train.y.to_numpy())
        assert np.abs(g).max() < 1e-4
    assert dict(fits.coefficients(3))["flat"] == 0.0


def test_ridge_runs_equal_normal_equations(mixed):
    stored = stored_table(mixed, "value", 2)
    plan = B.layout(stored, ["a", "b"])
    fits = B.fit_runs(stored, plan, [B.Run("x", ("a", "b"), "baseline", t) for t in range(2)], "LR", {"alpha": 0.5}, True, 0)
    pdf = stored.toPandas()
    for t in range(2):
        train = pdf[pdf.fold != t]
        x = np.stack([(train[c] - train[c].mean()) / train[c].std(ddof=0) for c in ("a", "b")], axis=1)
        y = train.value.to_numpy() - train.value.mean()
        want = np.linalg.solve(x.T @ x / len(y) + 0.5 * np.eye(2), x.T @ y / len(y))
        assert [v for _, v in fits.coefficients(t)] == pytest.approx(want, rel=1e-9)


def test_softmax_run_is_optimal(mixed):
    df = mixed.withColumn("code", F.substring("kind", 2, 1).cast("int"))
    stored = stored_table(df, "code", 2)
    plan = B.layout(stored, ["a", "g"])
    fits = B.fit_runs(stored, plan, [B.Run("x", ("a", "g"), "baseline", 0)], "LR", {}, False, 3)
    p, train = fits.problems[0], stored.where("fold <> 0").toPandas()
    x = np.stack([np.ones(len(train)), *[(train.g == v) for v in ("u", "v", "w")], (train.a - train.a.mean()) / train.a.std(ddof=0)], axis=1).astype(float)
    z = x @ p.b
    e = np.exp(z - z.max(axis=1, keepdims=True))
    r = e / e.sum(axis=1, keepdims=True) - np.eye(3)[train.code]
    penalty = p.b.copy()
    penalty[0] = 0
    assert np.abs(x.T @ r + penalty).max() < 1e-4


def test_squared_hinge_of_two_points(spark):
    """x = -1 and 1: symmetry puts the intercept at 0; w = 4C / (1 + 4C)."""
    df = spark.createDataFrame([(0, -1.0, 0), (1, 1.0, 1)], "id int, x double, y int")
    for c in (0.1, 1.0, 10.0):
        fitted = fit_model(df, ["x"], "y", "SVM", {"C": c}, regression=False)
        assert fitted.coefficients()[0][1] == pytest.approx(4 * c / (1 + 4 * c), abs=1e-9)
        p = {r.id: r.p for r in fitted.predict(df).collect()}
        assert p[1] == pytest.approx(1 / (1 + np.exp(-4 * c / (1 + 4 * c)))) and p[0] == pytest.approx(1 - p[1])


def test_squared_hinge_is_optimal(mixed):
    fitted = fit_model(mixed, ["a", "b"], "y", "SVM", {"C": 0.7}, regression=False)
    pdf = mixed.toPandas()
    x = np.stack([np.ones(len(pdf)), *[(pdf[c] - pdf[c].mean()) / pdf[c].std(ddof=0) for c in ("a", "b")]], axis=1)
    w = np.array([fitted.model.intercept, *fitted.model.coefficients.toArray()])
    sign = 2 * pdf.y.to_numpy() - 1
    short = np.maximum(1 - sign * (x @ w), 0)
    assert np.abs(w - 2 * 0.7 * x.T @ (sign * short)).max() < 1e-5


def test_all_trials_are_balanced_as_each_alone(mixed):
    folded = stored_table(mixed, "y", 3)
    for method, fn in METHODS.items():
        times, refused = balanced_times(folded, method, "__y", "id", ["site"], 3)
        assert not refused
        got = {(r.id, r.trial): r.times for r in times.collect()}
        want = {}
        for t in range(3):
            for r in fn(folded.where(F.col("fold") != t), "__y", "id", ["site"]).groupBy("id").count().collect():
                want[r.id, t] = r["count"]
        assert got == want


def test_trials_that_cannot_be_balanced(spark):
    # of the second site's positives, trial 0 leaves one
    rows = [(i, i % 2, "s", i % 3) for i in range(60)] + [(60, 1, "t", 0), (61, 1, "t", 0), (62, 1, "t", 1), (63, 0, "t", 1), (64, 0, "t", 2), (65, 0, "t", 2)]
    df = spark.createDataFrame(rows, "id int, y int, site string, fold int")
    assert balanced_times(df, "downsample", "y", "id", ["site"], 3)[1] == [0, 2]


def jobs_of(spark, name, fn):
    spark.sparkContext.setJobGroup(name, name)
    fn()
    found = spark.sparkContext.statusTracker().getJobIdsForGroup(name)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(found)


def test_jobs_do_not_follow_the_runs(spark, mixed):
    sets = {f"s{i}": f for i, f in enumerate([["a"], ["b"], ["a", "b"], ["a", "g"], ["g"], ["site"], ["a", "site"], ["b", "site"], ["b", "g"], ["a", "b", "g"]])}
    run = lambda feats, folds: estimate_associations(mixed, "id", ["lbl"], feats, controls={"downsample": ["site"]}, folds=folds).scores.count()
    few = jobs_of(spark, "few", lambda: run({"s0": ["a", "g"], "s1": ["b", "site"]}, 2))
    many = jobs_of(spark, "many", lambda: run(sets, 5))  # 100 runs instead of 8
    assert many <= few + 12


def test_estimates_equal_fits_one_by_one(mixed):
    found = estimate_associations(mixed, "id", ["lbl"], {"all": ["a", "b", "g"]}, {"held": mixed.where("id < 50")}, {"upsample": ["site"]}, folds=2, seed=3, with_predictions=True)
    base = mixed.withColumn("__y", (F.col("lbl") == "yes").cast("bigint"))
    folded = stratified_kfold(base, "__y", "id", 2, 3)
    for kind in ("baseline", "upsample[site]"):
        train = folded.where("fold <> 1")
        if kind != "baseline":
            train = METHODS["upsample"](train, "__y", "id", ["site"], 3)
        want = dict(fit_model(train, ["a", "b", "g"], "__y", regression=False).coefficients())
        got = {r.feature: r.coef for r in found.coefs.where((F.col("trial") == 1) & (F.col("type") == kind)).collect()}
        assert got == pytest.approx(want, abs=2e-3)
        seen = found.predictions.where((F.col("trial") == 1) & (F.col("type") == kind) & (F.col("eval_set") == "train")).count()
        assert seen == train.count()
    assert found.predictions.where("eval_set = 'held'").count() == 50 * 4


def test_rows_without_label_and_nulls(spark):
    rows = [(i, None if i % 10 == 0 else ("yes" if i % 3 else "no"), None if i % 7 == 0 else float(i % 5), None if i % 11 == 0 else "g%d" % (i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, lbl string, x double, g string")
    found = estimate_associations(df, "id", ["lbl"], {"all": ["x", "g"]}, folds=2)
    assert found.scores.where("value is null").count() == 0 and found.runs.agg(F.sum("n_samples")).first()[0] == 180


def test_scores_of_counted_predictions_are_those_of_all_rows(spark, monkeypatch):
    """Where inputs are categories, few distinct predictions leave a task, and stand for all rows."""
    from pyspark.sql import functions as F

    from evenkeel.plans import runs

    df = spark.range(900).select("id", F.concat(F.lit("g"), F.col("id") % 4).alias("g"), (F.col("id") % 7 < F.col("id") % 4).cast("int").alias("y"), F.rand(3).alias("x"))
    held = df.withColumn("y", F.when(F.col("id") % 5 > 0, F.col("y")))
    made = []
    inner = runs.predict_runs

    def spy(*args):
        found = inner(*args)
        made.append((args[-1], found.count()))
        return found

    monkeypatch.setattr(runs, "predict_runs", spy)
    options = dict(holdouts={"held": held}, controls={"downsample": ["g"], "upsample": ["g"]}, metrics=("balanced_accuracy", "d2", "logodds_mae", "roc_auc"), folds=2)
    for inputs in (["g"], ["g", "x"]):
        got = [runs.estimate_associations(df, "id", ["y"], {"a": inputs}, with_predictions=full, **options).scores.toPandas() for full in (False, True)]
        both = got[0].merge(got[1], on=[c for c in got[0].columns if c != "value"])
        assert len(both) == len(got[0]) == len(got[1]) > 0
        assert (both.value_x - both.value_y).abs().max() < 1e-9 and both.value_x.notna().all()
    (few, n), (_, every) = made[:2]
    assert few and n * 5 < every
