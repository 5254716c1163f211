"""Queries over the prediction metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.catalog.registry import query, r, rnd, u
from evenkeel.catalog.splits import order_by_hash
from evenkeel.catalog.views import (
    BACC, D2, LL, LO_MSE, LO_R2, LOGIT_P, LOGIT_Y, SETS, samples, scored, scores, table, with_ctes,
)
from evenkeel.functions.stats import expit
from evenkeel.operators import metrics as M
from evenkeel.operators.balance import counterbalance_down

BY = ["eval_set", "fold"]


def grouped(expr: str, name: str, digits: int = 6) -> str:
    return with_ctes("scored") + f"SELECT eval_set, fold, {r(expr, digits)} AS {name} FROM scored GROUP BY 1, 2"


def one(name, digits=6):
    def run(spark, d):
        out = M.score(scored(spark, d), "y", "p", BY, [name])
        return out.withColumn(name, rnd(name, digits))

    return run


def balanced_region_scores(spark, d):
    """Label counterbalanced within segments, then scored per region."""
    df = samples(spark, d).withColumn("p", expit((F.col("price") - 250000.0) / 100000.0))
    kept = counterbalance_down(df, "y", "id", ["segment"], "42")
    out = M.score(kept, "y", "p", ["region"], ["balanced_accuracy", "d2"])
    n = out.select("region", rnd("balanced_accuracy").alias("balanced_accuracy"), rnd("d2").alias("d2"))
    return n.orderBy("region")


query("balanced_region_scores", with_ctes("samples") + f""", c AS (SELECT *, 1 / (1 + exp(-(price - 250000.0::DOUBLE) / 100000.0::DOUBLE)) AS p, count(*) OVER (PARTITION BY segment, y) AS n,
  row_number() OVER (PARTITION BY segment, y ORDER BY {order_by_hash()}) AS rn FROM samples),
 m AS (SELECT *, min(n) OVER (PARTITION BY segment) AS k FROM c)
 SELECT region, {r(BACC)} AS balanced_accuracy, {r(D2)} AS d2 FROM m WHERE rn <= k GROUP BY 1""")(balanced_region_scores)

query("accuracy", grouped("avg((y = (p > 0.5)::INT)::INT::DOUBLE)", "accuracy"))(one("accuracy"))
query("balanced_accuracy", grouped(BACC, "balanced_accuracy"))(one("balanced_accuracy"))
query("r2_score", grouped("1 - sum(pow(y - p, 2)) / (count(y) * var_pop(y))", "r2"))(one("r2"))
query("deviance", grouped(f"-2 * (round_even(-sum({LL}), 5) - 0.0)", "deviance", 4))(one("deviance", 4))
query("d2_score", grouped(D2, "d2"))(one("d2"))
query("logodds_r2", grouped(LO_R2, "logodds_r2"))(one("logodds_r2"))
query("logodds_mae", grouped(f"avg(abs({LOGIT_Y} - {LOGIT_P}))", "logodds_mae"))(one("logodds_mae"))
query("logodds_mse", grouped(LO_MSE, "logodds_mse"))(one("logodds_mse"))
query("loglik_ratio", grouped(f"avg({LL}) / (-ln(0.99::DOUBLE))", "loglikelihood_ratio"))(one("loglikelihood_ratio"))
query("d2_prior", grouped(f"1 - avg({LL}) / -(avg(y) * ln(avg(y)) + (1 - avg(y)) * ln(1 - avg(y)))", "d2_prior"))(one("d2_prior"))
query("d2_most_frequent", grouped(
    f"1 - sum({LL}) / -(least(sum(y), count(y) - sum(y)) * ln(2.220446049250313e-16::DOUBLE)"
    " + greatest(sum(y), count(y) - sum(y)) * ln(1 - 2.220446049250313e-16::DOUBLE))", "d2_most_frequent"))(one("d2_most_frequent"))


@query("d2_constant", grouped(f"1 - sum({LL}) / -(sum(1 - y) * ln(2.220446049250313e-16::DOUBLE) + sum(y) * ln(1 - 2.220446049250313e-16::DOUBLE))", "d2"))
def d2_constant(spark, d):
    out = M.score(scored(spark, d), "y", "p", BY, [("d2", M.d2_constant(1))])
    return out.withColumn("d2", rnd("d2"))


@query("d2_stratified", with_ctes("scored") + f""", q AS (SELECT *, ({u('id', "'null'", "'42'")} < avg(y) OVER (PARTITION BY eval_set, fold)) AS drawn FROM scored),
 l AS (SELECT *, {LL} AS ll, CASE WHEN (y = 1) = drawn THEN -ln(1 - 2.220446049250313e-16::DOUBLE) ELSE -ln(2.220446049250313e-16::DOUBLE) END AS nl FROM q)
 SELECT eval_set, fold, {r('1 - sum(ll) / sum(nl)')} AS d2 FROM l GROUP BY 1, 2""")
def d2_stratified(spark, d):
    return M.d2_stratified(scored(spark, d), "y", "p", "id", BY, "42").withColumn("d2", rnd("d2"))


@query("d2_from_logits", with_ctes("scored") + f"SELECT eval_set, fold, {r(D2)} AS d2 FROM scored GROUP BY 1, 2")
def d2_from_logits(spark, d):
    return M.d2_from_logits(scored(spark, d), "y", "logit", BY).withColumn("d2", rnd("d2"))


@query("d2_multiclass", f"""WITH z AS (SELECT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS c, l_linestatus,
  [l_discount * 10, l_tax * 10, l_quantity / 50] AS z FROM lineitem),
 e AS (SELECT c, l_linestatus, exp(z[c]) / (exp(z[1]) + exp(z[2]) + exp(z[3])) AS q FROM z)
 SELECT l_linestatus, {r('1 - avg(-ln(q)) / ln(3.0::DOUBLE)')} AS d2 FROM e GROUP BY 1""")
def d2_multiclass(spark, d):
    li = table(spark, d, "lineitem")
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    z = F.array(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50)
    out = M.d2_multiclass(li.select("l_linestatus", code.alias("c"), z.alias("z")), "c", "z", 3, ["l_linestatus"], True)
    return out.withColumn("d2", rnd("d2"))


@query("balanced_accuracy_multiclass", f"""WITH p AS (SELECT l_linestatus, l_returnflag, CASE WHEN l_discount < 0.035 THEN 'A' WHEN l_discount < 0.065 THEN 'N' ELSE 'R' END AS pred FROM lineitem),
 c AS (SELECT l_linestatus, l_returnflag, avg((l_returnflag = pred)::INT::DOUBLE) AS rec FROM p GROUP BY 1, 2)
 SELECT l_linestatus, {r('avg(rec)')} AS balanced_accuracy FROM c GROUP BY 1""")
def balanced_accuracy_multiclass(spark, d):
    pred = F.when(F.col("l_discount") < 0.035, "A").when(F.col("l_discount") < 0.065, "N").otherwise("R")
    li = table(spark, d, "lineitem").withColumn("pred", pred)
    out = M.balanced_accuracy_multiclass(li, "l_returnflag", "pred", ["l_linestatus"])
    return out.withColumn("balanced_accuracy", rnd("balanced_accuracy"))


@query("roc_auc", with_ctes("scored") + f""", k AS (SELECT eval_set, fold, y, rank() OVER w + (count(*) OVER (PARTITION BY eval_set, fold, p) - 1) / 2.0::DOUBLE AS rk
  FROM scored WINDOW w AS (PARTITION BY eval_set, fold ORDER BY p))
 SELECT eval_set, fold, {r('(sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * (count(*) - sum(y)))')} AS roc_auc FROM k GROUP BY 1, 2""")
def roc_auc(spark, d):
    return M.roc_auc(scored(spark, d), "y", "p", BY).withColumn("roc_auc", rnd("roc_auc"))


@query("roc_auc_ties", f"""WITH s AS (SELECT l_linestatus AS g, (l_returnflag = 'R')::INT AS y, l_quantity AS p FROM lineitem),
 k AS (SELECT g, y, rank() OVER (PARTITION BY g ORDER BY p) + (count(*) OVER (PARTITION BY g, p) - 1) / 2.0::DOUBLE AS rk FROM s)
 SELECT g, {r('(sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * (count(*) - sum(y)))')} AS roc_auc FROM k GROUP BY 1""")
def roc_auc_ties(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("g"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_quantity").alias("p"))
    return M.roc_auc(li, "y", "p", ["g"]).withColumn("roc_auc", rnd("roc_auc"))


@query("score_all", with_ctes("scored") + f"""SELECT eval_set, {r('avg((y = (p > 0.5)::INT)::INT::DOUBLE)')} AS accuracy, {r(BACC)} AS balanced_accuracy,
 {r('1 - sum(pow(y - p, 2)) / (count(y) * var_pop(y))')} AS r2, {r(D2)} AS d2, {r(LO_R2)} AS logodds_r2, {r(LO_MSE)} AS logodds_mse, {r('avg(price * y)', 3)} AS positive_value FROM scored GROUP BY 1""")
def score_all(spark, d):
    """Registered metrics and one of the user's own in a single aggregation."""
    df = scored(spark, d)
    mine = ("positive_value", lambda y, p: F.avg(F.col("price") * y))
    names = ["accuracy", "balanced_accuracy", "r2", "d2", "logodds_r2", "logodds_mse"]
    out = M.score(df, "y", "p", ["eval_set"], [*names, mine])
    return out.select("eval_set", *[rnd(n).alias(n) for n in names], rnd("positive_value", 3).alias("positive_value"))


@query("score_wide", with_ctes("ev") + "SELECT dataset, trial, " + ", ".join(
    f"""max(CASE WHEN eval_set = '{s}' THEN {r(m)} END) AS "score_holdout_{s.replace('_', '-')}_{m.replace('_', '-')}\""""
    for s in SETS for m in ("d2", "balanced_accuracy")) + " FROM ev GROUP BY 1, 2")
def score_wide(spark, d):
    long = scores(spark, d).withColumn("value", rnd("value"))
    return M.score_wide(long, ["dataset", "trial"], SETS, ["d2", "balanced_accuracy"])


