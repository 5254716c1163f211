import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import metrics as M
from evenkeel.operators import sizing

RNG = np.random.default_rng(0)
Y = (RNG.random(400) < 0.4).astype(int)
P = np.clip(RNG.normal(0.4 + 0.2 * Y, 0.2), 0, 1)  # holds exact zeros and ones
EPS = np.finfo(float).eps


@pytest.fixture(scope="module")
def pred(spark):
    return spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(Y, P))], "id int, y int, p double")


def logloss(y, p):
    q = np.clip(p, EPS, 1 - EPS)
    return -np.where(y == 1, np.log(q), np.log(1 - q))


def lo(p):
    q = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def pseudo():
    q = np.clip(Y.astype(float), 0.01, 0.99)
    return np.log(q / (1 - q))


HAT = (P > 0.5).astype(int)
EXPECTED = {
    "accuracy": (Y == HAT).mean(),
    "balanced_accuracy": ((HAT[Y == 1] == 1).mean() + (HAT[Y == 0] == 0).mean()) / 2,
    "r2": 1 - ((Y - P) ** 2).sum() / ((Y - Y.mean()) ** 2).sum(),
    "deviance": 2 * logloss(Y, P).sum(),
    "d2": 1 - logloss(Y, P).mean() / math.log(2),
    "d2_prior": 1 - logloss(Y, P).sum() / logloss(Y, np.full(400, Y.mean())).sum(),
    "d2_most_frequent": 1 - logloss(Y, P).sum() / logloss(Y, np.zeros(400)).sum(),
    "logodds_r2": 1 - ((pseudo() - lo(P)) ** 2).sum() / ((pseudo() - pseudo().mean()) ** 2).sum(),
    "logodds_mae": np.abs(pseudo() - lo(P)).mean(),
    "logodds_mse": ((pseudo() - lo(P)) ** 2).mean(),
    "loglikelihood_ratio": logloss(Y, P).mean() / logloss(Y, np.clip(Y.astype(float), 0.01, 0.99)).mean(),
}


@pytest.mark.parametrize("name", sorted(M.METRICS))
def test_metric_matches_numpy(pred, name):
    got = M.score(pred, "y", "p", [], [name]).first()[name]
    assert got == pytest.approx(EXPECTED[name], rel=1e-6, abs=1e-5)


def test_all_metrics_in_one_aggregation(pred):
    df = M.score(pred, "y", "p", ["id"], list(M.METRICS))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    d = pos[:, None] - neg[None, :]
    return ((d > 0).sum() + 0.5 * (d == 0).sum()) / d.size


@pytest.mark.parametrize("target", [2_000_000, 30])
def test_auc_with_ties_in_one_or_many_buckets(pred, monkeypatch, target):
    for f in (sizing.ValueStats.splits, sizing.ValueStats.parts):
        monkeypatch.setattr(f, "__defaults__", (target,))
    got = M.roc_auc(pred.withColumn("p", F.round("p", 1)), "y", "p").first()[0]
    assert got == pytest.approx(auc(Y, np.round(P + 1e-12, 1)), abs=5e-3)
    got = M.roc_auc(pred.withColumn("g", F.col("id") % 3), "y", "p", ["g"]).collect()
    for r in got:
        m = np.arange(400) % 3 == r.g
        assert r.roc_auc == pytest.approx(auc(Y[m], P[m]))


def test_auc_of_one_class_is_null(pred):
    assert M.roc_auc(pred.where("y = 1"), "y", "p").first()[0] is None


def test_constant_label_gives_null_not_an_error(pred):
    r = M.score(pred.where("y = 1"), "y", "p", [], ["r2", "logodds_r2", "balanced_accuracy"]).first()
    assert r["r2"] is None and r["logodds_r2"] is None
    assert r["balanced_accuracy"] == pytest.approx((HAT[Y == 1] == 1).mean())


def test_user_metric_and_unknown_name(pred):
    got = M.score(pred, "y", "p", [], [("mean_p", lambda y, p: F.avg(p))]).first()["mean_p"]
    assert got == pytest.approx(P.mean())
    with pytest.raises(ValueError):
        M.score(pred, "y", "p", [], ["no_such_metric"])


def test_true_probabilities_in_the_likelihood_ratio(pred):
    mine = ("r", lambda y, p: M.loglikelihood_ratio(y, p, F.col("p")))
    assert M.score(pred, "y", "p", [], [mine]).first()["r"] == pytest.approx(1)


def test_multiclass_forms(spark):
    z = RNG.normal(size=(60, 3))
    y = RNG.integers(0, 3, 60)
    df = spark.createDataFrame([(int(a), [float(v) for v in b]) for a, b in zip(y, z)], "y int, z array<double>")
    e = np.exp(z - z.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    want = 1 - (-np.log(p[np.arange(60), y])).mean() / math.log(3)
    assert M.d2_multiclass(df, "y", "z", 3, from_logits=True).first()[0] == pytest.approx(want)
    hat = df.withColumn("hat", (F.array_position("z", F.array_max("z")) - 1).cast("int"))
    want = np.mean([(z.argmax(1)[y == c] == c).mean() for c in range(3)])
    assert M.balanced_accuracy_multiclass(hat, "y", "hat").first()[0] == pytest.approx(want)


def test_wide_names(pred):
    long = M.score_long(pred.withColumn("eval_set", F.when(F.col("id") < 200, "test").otherwise("test_with_a_b")),
                        "y", "p", ["eval_set"], ["d2", "logodds_r2"])
    wide = M.score_wide(long.withColumn("run", F.lit(1)), ["run"], ["test", "test_with_a_b"], ["d2", "logodds_r2"])
    assert wide.columns[1:] == ["score_test_d2", "score_test_logodds-r2", "score_holdout_test-with-a-b_d2",
                                "score_holdout_test-with-a-b_logodds-r2"]


def test_stratified_null_is_worse_than_uniform(pred):
    assert M.d2_stratified(pred, "y", "p", "id", [], 1).first()[0] > 0.5
