import math

import math

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from evenkeel.operators import features as X
from evenkeel.operators import frames
from evenkeel.operators.contracts import ContractError
from evenkeel.operators.residual import residualize_categorical, residualize_continuous
from evenkeel.operators.rules import layered_assign
from evenkeel.plans import models as H
from evenkeel.plans.runs import estimate_associations, run_matrix

RNG = np.random.default_rng(1)
N = 600
A, B = RNG.normal(size=N), RNG.normal(size=N) * 3 + 1
G = RNG.integers(0, 3, N)
YC = (RNG.random(N) < 1 / (1 + np.exp(-(1.2 * A - 0.3 * B + 0.5 * (G == 1))))).astype(int)
YV = 2 * A - 0.5 * B + RNG.normal(size=N) * 0.3


@pytest.fixture(scope="module")
def data(spark):
    pdf = pd.DataFrame({"id": range(N), "a": A, "b": B, "g": [f"g{i}" for i in G], "y": YC, "v": YV})
    return spark.createDataFrame(pdf)


def z(x):
    return (x - x.mean()) / x.std()


def newton_logistic(x, y, c):
    """Minimiser of c * log loss + |w|^2 / 2 with a free intercept."""
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(x1.shape[1])
    pen = np.eye(x1.shape[1])
    pen[-1, -1] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-x1 @ w))
        grad = c * x1.T @ (p - y) + pen @ w
        hess = c * (x1.T * (p * (1 - p))) @ x1 + pen
        w -= np.linalg.solve(hess, grad)
    return w


def test_scaler_uses_population_std_and_survives_constants(data):
    df = data.withColumn("k", F.lit(5.0))
    out = X.fit_scaler(df, ["a", "k"]).transform(df).toPandas().sort_values("id")
    assert np.allclose(out.a, z(A)) and (out.k == 0).all()


def test_one_hot_ignores_unseen(data):
    enc = X.fit_one_hot(data.where("g <> 'g2'"), ["g"])
    assert enc.names() == ["g_g0", "g_g1"]
    r = enc.transform(data.where("g = 'g2'")).first()
    assert (r["g_g0"], r["g_g1"]) == (0.0, 0.0)


def test_label_index_is_learned_on_train(data):
    got = X.label_index(data.where("g <> 'g0'"), "g", "c", fit_on=data)
    assert {(r.g, r.c) for r in got.select("g", "c").distinct().collect()} == {("g1", 1), ("g2", 2)}
    unseen = X.label_index(data, "g", "c", fit_on=data.where("g <> 'g2'")).where("g = 'g2'").first()
    assert unseen["c"] is None


def test_ordinal_codes_follow_the_order_of_values(data):
    want = {v: i for i, v in enumerate(sorted(A))}
    assert all(want[r.a] == r.c for r in X.ordinal_encode(data, "a", "c").collect())


def test_polynomial_names_and_degrees(data):
    assert X.polynomial(data, ["a", "b"], 0)[1] == []
    assert X.polynomial(data, ["a", "b"], 1, interaction_only=True)[1] == ["a", "b"]
    out, names = X.polynomial(data, ["a", "b"], 2)
    assert names == ["a", "b", "a^2", "a b", "b^2"]
    r = out.where("id = 3").first()
    assert r["a b"] == pytest.approx(A[3] * B[3]) and r["b^2"] == pytest.approx(B[3] ** 2)
    assert X.polynomial(data, ["a", "b"], 2, interaction_only=True)[1] == ["a", "b", "a b"]


def test_bins_match_pandas_cut(data):
    got = X.cut_equal_width(data, "b", "bin").toPandas().sort_values("id").bin
    want = pd.cut(pd.Series(B), bins=3, labels=[1, 2, 3]).astype(int)
    assert (got.values == want.values).all()
    few = X.cut_equal_width(data.withColumn("q", F.col("id") % 4), "q", "bin")
    assert few.where("q <> bin").count() == 0


def test_task_inference(data):
    task = lambda df, c: X.infer_task(df, c).first()["task"]
    assert task(data, "v") == "regression" and task(data, "y") == "classification"
    assert task(data, "g") == "classification"
    assert task(data.withColumn("s", (F.col("id") % 5).cast("string")), "s") == "regression"


def test_column_routing(data):
    assert X.route_columns(data, ["a", "g", "b"]) == (["g"], ["a", "b"])
    wide = data.select("g", *[F.lit(i).alias(f"c{i}") for i in range(100)])
    with pytest.raises(ContractError):
        X.route_columns(wide, wide.columns)
    enc = H.fit_encoder(wide.withColumn("c7", F.rand(1)), [f"c{i}" for i in range(100)])
    assert enc.inputs == ["c7"]  # constants dropped from a matrix


def test_roles_and_selection(spark):
    df = spark.createDataFrame([(1, "s0", "a", 2, [0.5, 0.5])], "subjectID int, lbl_y string, cov_1 string, shape int, probas_lbl_y array<double>")
    r = frames.columns_by_role(df, "subjectID")
    assert (r.labels, r.covariates, r.attributes, r.probas) == (["lbl_y"], ["cov_1"], ["shape"], ["probas_lbl_y"])
    assert frames.model_frame(df, ["shape"], "lbl_y", ["cov_1"]).columns == ["shape", "lbl_y", "probas_lbl_y", "cov_1"]
    assert frames.select_prefix(df, ["cov_", "lbl_"], ["subjectID"]).columns == ["subjectID", "lbl_y", "cov_1"]
    assert frames.sort_columns(df).columns == sorted(df.columns)


def test_feature_sets_drop_the_label(spark):
    e = spark.createDataFrame([("cov_a", "attr_y"), ("cov_a", "attr_x"), ("cov_b", "lbl_y"), ("attr_x", "lbl_y"), ("cov_b", "cov_a")],
                              "parent string, child string")
    got = {r.name: r.features for r in frames.feature_sets(
        e, ["attr_subsets", "attr_superset", "cov_subsets", "attr_all", "cov_all"], "lbl_y", ["attr_x", "attr_y"], ["cov_a", "cov_b"]).collect()}
    assert got == {"attr_attr_x, attr_y": ["attr_x", "attr_y"], "attr_superset": ["attr_x", "attr_y"], "lbl_y": [],
                   "cov_a, lbl_y": ["cov_a"], "attr_all": ["attr_x", "attr_y"], "cov_all": ["cov_a", "cov_b"]}
    with pytest.raises(ValueError):
        frames.feature_sets(e, ["images"])


def test_null_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "i int, s string")
    assert rows(frames.filter_allowed(df, {"s": ["a", None]}), "i") == [(1,), (2,)]
    assert rows(frames.filter_allowed(df, {"s": ["a"], "i": [1, 3]}), "i") == [(1,)]
    assert frames.drop_null(df, ["s"]).count() == 2
    assert rows(frames.clip_lower(df, ["i"], 2), "i") == [(2,), (2,), (3,)]


def test_residuals(data):
    out = residualize_categorical(data, ["a", "b"], "g")
    means = [r[1] for r in out.groupBy("g").agg(F.avg("b_res")).collect()]
    assert np.allclose(means, B.mean())
    res = residualize_continuous(data, ["v"], "a").toPandas().sort_values("id").v_res
    assert np.allclose(res, YV - np.polyfit(A, YV, 1)[0] * A)
    with pytest.raises(ContractError):
        residualize_continuous(data.withColumn("k", F.col("id") % 5), ["v"], "k")


def test_residuals_of_many_groups_use_a_shuffle_join(data, monkeypatch):
    want = rows(residualize_categorical(data, ["a"], "g"), "id", F.round("a_res", 9))
    monkeypatch.setattr("evenkeel.operators.residual.broadcast_if_small", lambda df: df)
    assert rows(residualize_categorical(data, ["a"], "g"), "id", F.round("a_res", 9)) == want


@pytest.mark.parametrize("c", [0.05, 1.0])
def test_logistic_matches_newton(data, c):
    fit = H.fit_model(data, ["a", "b", "g"], "y", "LR", {"C": c})
    x = np.c_[G == 0, G == 1, G == 2, z(A), z(B)].astype(float)
    want = newton_logistic(x, YC, c)
    got = dict(fit.coefficients())
    assert list(got) == ["g_g0", "g_g1", "g_g2", "a", "b"]
    assert np.allclose(list(got.values()), want[:-1], atol=2e-3)
    p = fit.predict(data).toPandas().sort_values("id").p
    assert np.allclose(p, 1 / (1 + np.exp(-(np.c_[x, np.ones(N)] @ want))), atol=2e-3)


def test_unseen_categories_are_zeros(data):
    fit = H.fit_model(data, ["a", "g"], "y")
    assert {"g_g0", "g_g1", "g_g2", "a"} == set(dict(fit.coefficients()))
    unseen = data.withColumn("g", F.lit("never seen"))
    p = fit.predict(unseen).toPandas()
    assert p.p.notna().all() and len(p) == N


def test_ridge_and_lasso_closed_forms(data):
    x = np.c_[z(A), z(B)]
    yc = YV - YV.mean()
    ridge = H.fit_model(data, ["a", "b"], "v", "LR", {"C": 2.0})
    want = np.linalg.solve(x.T @ x / N + 0.5 * np.eye(2), x.T @ yc / N)
    assert ridge.regression and np.allclose([c for _, c in ridge.coefficients()], want, atol=1e-3)
    w = np.zeros(2)
    for _ in range(500):  # coordinate descent
        for j in range(2):
            r = yc - x @ w + x[:, j] * w[j]
            rho = x[:, j] @ r / N
            w[j] = np.sign(rho) * max(abs(rho) - 0.4, 0)
    lasso = H.fit_model(data, ["a", "b"], "v", "LR", {"penalty": "l1", "alpha": 0.4})
    assert np.allclose([c for _, c in lasso.coefficients()], w, atol=5e-3)


@pytest.mark.parametrize("kind, params", [("SVM", {"max_iter": 30}), ("RF", {"n_estimators": 20, "max_depth": 4}),
                                          ("MLP", {"hidden_layer_sizes": (6,), "max_iter": 60})])
def test_other_classifiers_learn(data, kind, params):
    fit = H.fit_model(data, ["a", "b"], "y", kind, params, seed=3)
    got = fit.predict(data).toPandas()
    assert got.p.between(0, 1).all() and ((got.p > 0.5) == (got.y == 1)).mean() > 0.7


def test_unavailable_models_say_so(data):
    with pytest.raises(ValueError):
        H.fit_model(data, ["a"], "v", "MLP")
    with pytest.raises(ValueError):
        H.fit_model(data, ["a"], "y", "KNN")


def test_glm_matches_least_squares(data):
    got = {r.feature: r for r in H.gaussian_glm(data, ["a", "b"], "v").collect()}
    x1 = np.c_[A, B, np.ones(N)]
    w, rss = np.linalg.lstsq(x1, YV, rcond=None)[:2]
    se = np.sqrt(np.diag(np.linalg.inv(x1.T @ x1)) * rss[0] / (N - 3))
    for i, f in enumerate("ab"):
        assert got[f].coef == pytest.approx(w[i]) and got[f].stderr == pytest.approx(se[i])
        assert got[f].p == pytest.approx(math.erfc(abs(w[i] / se[i]) / math.sqrt(2)), abs=1e-9)
    assert got["a"].pseudo_r2 == pytest.approx(1 - rss[0] / ((YV - YV.mean()) ** 2).sum())


def test_glm_gate(data):
    noise = data.withColumn("noise", (F.col("id") * 53 % 89).cast("double"))
    got = {r.feature: r.coef for r in H.gaussian_glm(noise, ["a", "b", "noise"], "v", gate=True).collect()}
    assert got["a"] != 0 and got["noise"] == 0


def test_collinear_designs_get_the_minimum_norm_solution(data):
    wide = X.fit_one_hot(data, ["g"]).transform(data)
    xs = ["a", "g_g0", "g_g1", "g_g2"]
    got = {r.feature: r for r in H.gaussian_glm(wide, xs, "v").collect()}
    x1 = np.c_[np.ones(N), A, G == 0, G == 1, G == 2].astype(float)
    want = np.linalg.pinv(x1) @ YV
    rss = ((YV - x1 @ want) ** 2).sum()
    se = np.sqrt(rss / (N - 4) * np.diag(np.linalg.pinv(x1.T @ x1)))
    for i, f in enumerate(xs, 1):
        assert got[f].coef == pytest.approx(want[i], abs=1e-8) and got[f].stderr == pytest.approx(se[i])
    const = {r.feature: r.coef for r in H.gaussian_glm(data.withColumn("k", F.lit(3.0)), ["a", "k"], "v").collect()}
    want = np.linalg.pinv(np.c_[np.ones(N), A, np.full(N, 3.0)]) @ YV
    assert const["a"] == pytest.approx(want[1]) and const["k"] == pytest.approx(want[2])
    tiny = H.gaussian_glm(data.where("id < 2"), ["a", "b"], "v").collect()
    assert all(r.coef == 0 and r.pseudo_r2 is None for r in tiny)


def test_pca_centres_and_orders(spark, data):
    df = data.select("id", F.array(F.col("b") + 100, F.col("a"), F.col("a") + F.col("b")).alias("vec"))
    out = H.fit_pca(df, "vec", 2)(df).toPandas()
    pc = np.array(out.pca.tolist())
    assert np.allclose(pc.mean(0), 0, atol=1e-9) and pc[:, 0].var() > pc[:, 1].var()
    m = np.c_[B + 100, A, A + B]
    want = np.sort(np.linalg.eigvalsh(np.cov(m.T)))[::-1][:2]
    assert np.allclose(pc.var(0, ddof=1), want)


def test_assigned_effect_is_recovered(spark):
    """A label drawn with a known log-odds effect is refit to that effect."""
    rules = spark.createDataFrame([("x", "1", "lbl_y", [0.0, 2.0]), ("x", "0", "lbl_y", [0.0, -2.0])],
                                  "parent string, state string, child string, w array<double>")
    states = spark.createDataFrame([("lbl_y", 0, "s0"), ("lbl_y", 1, "s1")], "var string, ix int, state string")
    df = layered_assign(spark.range(4000).withColumn("x", F.col("id") % 2), states, rules, "id", 1)
    df = df.withColumn("y", (F.col("lbl_y") == "s1").cast("int")).withColumn("x", F.col("x").cast("double"))
    beta = H.fit_model(df, ["x"], "y", "LR", {"penalty": None}).coefficients()[0][1]
    assert beta / 0.5 == pytest.approx(4.0, abs=0.35)  # x is standardised: std 0.5


def test_run_matrix_skips_label_only_sets(spark):
    sets = spark.createDataFrame([("all", ["a", "b"]), ("lbl", ["y"]), ("none", [])], "name string, features array<string>")
    got = run_matrix(sets, ["y", "w"], {"downsample": ["g"]}, 2)
    assert got.count() == 12  # (all, lbl) x (y, w) without (lbl, y), 2 controls, 2 folds
    assert {r.type for r in got.collect()} == {"baseline", "downsample[g]"}
    assert got.where("out = 'y' and inp = 'lbl'").count() == 0


def test_estimated_associations(data):
    df = data.withColumn("lbl", F.when(F.col("y") == 1, "yes").otherwise("no"))
    scores, coefs = estimate_associations(
        df, "id", ["lbl"], {"attr": ["a", "b"]}, {"test_none": df.withColumn("a", -F.col("a"))},
        {"downsample": ["g"]}, metrics=["balanced_accuracy", "d2"], folds=2)
    got = scores.toPandas()
    assert len(got) == 2 * 2 * 3 * 2 and set(got.eval_set) == {"train", "test", "test_none"}
    mean = got[got.metric == "d2"].groupby("eval_set").value.mean()
    assert mean["test"] > 0.1 > mean["test_none"]
    assert set(coefs.toPandas().feature) == {"a", "b"}


def test_label_codes_have_no_cap(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("c"), F.lpad((F.col("id") % 1500).cast("string"), 4, "0")).alias("y"))
    got = X.label_index(df, "y", "code")
    assert got.where(F.col("code") == F.col("id") % 1500).count() == 3000
    assert X.fit_one_hot(df.where("id < 1200"), ["y"]).names()[-1] == "y_c1199"


@pytest.fixture(scope="module")
def three(spark):
    """Three classes that x tells apart, a number, and a rare second table."""
    df = spark.range(240).select(
        "id", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("kind"),
        ((F.col("id") % 3) * 10 + (F.col("id") % 7) / 10).alias("x"), (F.col("id") % 3 == 1).cast("double").alias("w"),
        ((F.col("id") % 3) * 2.5 + 1).alias("amount"), F.when(F.col("id") % 3 == 2, "yes").otherwise("no").alias("flag"),
    )
    return df.withColumn("probas_flag", F.when(F.col("flag") == "yes", F.array(F.lit(0.1), F.lit(0.9))).otherwise(F.array(F.lit(0.9), F.lit(0.1))))


def values(found, metric):
    return {r.eval_set: r.value for r in found.scores.where(F.col("metric") == metric).collect()}


def test_estimates_of_three_classes(three):
    found = estimate_associations(
        three, "id", ["kind"], {"all": ["x", "w"]}, {"held": three.where("id < 30")},
        params={"C": 1000.0}, metrics=("accuracy", "balanced_accuracy", "d2"), folds=2, with_predictions=True,
    )
    for metric in ("accuracy", "balanced_accuracy"):
        assert values(found, metric) == {"train": 1.0, "test": 1.0, "held": 1.0}
    assert min(values(found, "d2").values()) > 0.5
    pred = found.predictions
    assert pred.groupBy("trial", "eval_set").count().where("eval_set = 'held'").first()["count"] == 30
    assert pred.where("size(probas) = 3 and y = pred").count() == pred.count() == 2 * (240 + 30)
    assert found.runs.select("n_samples").distinct().first()[0] == 120
    with pytest.raises(ValueError, match="two classes"):
        estimate_associations(three, "id", ["kind"], {"all": ["x"]}, metrics=("logodds_r2",), folds=2)


def test_estimates_of_a_number_and_of_two_classes(three):
    found = estimate_associations(three, "id", ["amount"], {"all": ["x", "w"]}, params={"penalty": None}, folds=2)
    assert set(values(found, "r2")) == {"train", "test"} and min(values(found, "r2").values()) > 0.99
    found = estimate_associations(
        three, "id", ["flag"], {"all": ["x"]}, metrics=("roc_auc", "accuracy", "loglikelihood_ratio"), folds=2, with_predictions=True,
    )
    assert values(found, "roc_auc") == {"train": 1.0, "test": 1.0}
    one = found.predictions.where("trial = 0 and eval_set = 'test'")
    loss = one.agg((F.avg(-F.log(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")))) / -math.log(0.9)).alias("v")).first().v
    got = found.scores.where("metric = 'loglikelihood_ratio' and trial = 0 and eval_set = 'test'").first().value
    assert got == pytest.approx(loss, rel=1e-4)
