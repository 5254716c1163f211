
import pytest
from pyspark.sql import functions as F

from evenkeel.plans import effects as E

SOURCES = E.Sources(direct=("dir",), confounders=("cov_site",), indirect_attributes=("attr",))


@pytest.fixture(scope="module")
def study(spark):
    """A label driven by a direct attribute and by a site that also shows in ``attr``."""
    rules, states = [], []
    for i, s in enumerate(("a", "b")):
        sign = 1 if i else -1
        rules += [("cov_site", s, "attr", [-2.0 * sign, 2.0 * sign]), ("cov_site", s, "lbl_y", [0.0, 0.8 * sign]),
                  ("dir", f"d{i}", "lbl_y", [0.0, 1.6 * sign])]
        states += [("cov_site", i, s), ("dir", i, f"d{i}"), ("attr", i, f"x{i}"), ("lbl_y", i, f"s{i}")]
    r = spark.createDataFrame(rules, "parent string, state string, child string, w array<double>")
    st = spark.createDataFrame(states, "var string, ix int, state string")
    return E.counterfactual_experiment(
        spark.range(1500), st, r, "id", "lbl_y", SOURCES, ["dir", "attr"],
        metrics=["d2", "logodds_r2", "balanced_accuracy"], folds=2, dataset="study")


def test_every_table_is_scored(study):
    got = {(r.eval_set, r.trial) for r in study.scores.select("eval_set", "trial").distinct().collect()}
    sets = {"train", "test", "test_all", "test_none", "test_with_dir", "test_with_cov_site"}
    assert got == {(s, t) for s in sets for t in (0, 1)}
    assert study.counterfactuals.count() == 4 * 1500 and study.train.count() == 1500


def test_scores_fall_when_effects_are_off(study):
    r = E.effect_scores(study.scores.where("metric = 'd2'"), SOURCES).first()
    assert r.a_total > r.a_minus_con > r.a_none and r.a_total > r.a_minus_dir > r.a_none
    assert r.a_dir > r.a_con > 0  # the direct effect is twice the confounded one


def test_regression_finds_the_configured_effects(study):
    df = study.train.withColumn("p1", F.col("probas_lbl_y")[1])
    got = {(r.model, r.feature): r for r in E.regression_effects(df, "p1", SOURCES).collect()}
    beta = got[("gamma", "dir_d1")].coef - got[("gamma", "dir_d0")].coef
    gamma = got[("gamma", "cov_site_b")].coef - got[("gamma", "cov_site_a")].coef
    assert beta == pytest.approx(3.2, abs=0.1) and gamma == pytest.approx(1.6, abs=0.1)
    assert got[("gamma", "dir_d1")].role == "direct" and got[("theta", "attr_x1")].role == "indirect"
    assert got[("gamma", "dir_d1")].pseudo_r2 > 0.99
    names = {r.label for r in E.labelled_effects(E.regression_effects(df, "p1", SOURCES), " (1)").collect()}
    assert "$\\beta$ (1) (dir_d1)" in names and "$\\theta$ (1) (attr_x1)" in names


def test_polynomial_terms_and_folds(study):
    df = study.train.withColumns({"p1": F.col("probas_lbl_y")[1], "trial": F.col("id") % 2})
    got = E.regression_effects(df, "p1", SOURCES, "trial", degree=2)
    terms = {r.feature for r in got.where("model = 'poly'").collect()}
    assert "dir_d0 cov_site_a" in terms and "dir_d0^2" in terms


def test_attribution_compares_scores_with_shares(study):
    pred = study.counterfactuals.where("split = 'test_all'").withColumns(
        {"p": F.col("probas_lbl_y")[1], "trial": F.lit(0)})
    got = {r.metric: r for r in E.attribute_effects(pred, study.scores, SOURCES).collect()}
    r = got["logodds_r2"]
    assert r.beta_share == pytest.approx(2 / 3, abs=0.03) and r.gamma_share == pytest.approx(1 / 3, abs=0.03)
    assert r.dev_dir == pytest.approx(abs(r.a_dir - r.beta_share))


def test_roles_of_sets(spark):
    s = E.Sources(("l1", "l0"), ("c1",), ("m1",))
    names = ["test_all", "test_none", "test_with_c1--m1", "test_with_l0--l1", "test_with_c1"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    assert [r[0] for r in df.select(E.set_role(F.col("s"), s)).collect()] == [
        "a_total", "a_none", "a_minus_dir", "a_minus_con", None]
