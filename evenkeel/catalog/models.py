"""Queries over model fits. Iterative fits have no SQL twin and are tested against
numerical references instead; the least-squares ones do."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.catalog.registry import h, query, r, rnd
from evenkeel.catalog.views import edges_v, samples, scored, table, with_ctes
from evenkeel.operators.frames import feature_sets
from evenkeel.operators.splits import stratified_holdout
from evenkeel.plans.models import (
    baseline_fit,
    fit_model,
    fit_pca,
    gaussian_glm,
    predictions,
    reduced_grid_search,
)
from evenkeel.plans.runs import estimate_associations, run_matrix


@query("glm_two_predictor", f"""WITH g AS (SELECT l_returnflag, count(*) AS n, covar_pop(l_quantity, l_quantity) AS s11, covar_pop(l_quantity, l_discount) AS s12, covar_pop(l_discount, l_discount) AS s22,
  covar_pop(l_quantity, l_extendedprice) AS c1, covar_pop(l_discount, l_extendedprice) AS c2, var_pop(l_extendedprice) AS vy FROM lineitem GROUP BY 1),
 b AS (SELECT *, (s22 * c1 - s12 * c2) / (s11 * s22 - s12 * s12) AS b1, (s11 * c2 - s12 * c1) / (s11 * s22 - s12 * s12) AS b2, s11 * s22 - s12 * s12 AS det FROM g),
 v AS (SELECT *, n * (vy - b1 * c1 - b2 * c2) / (n - 3) AS s2, 1 - (vy - b1 * c1 - b2 * c2) / vy AS r2 FROM b)
 SELECT l_returnflag, 'l_quantity' AS feature, {r('b1', 3)} AS coef, {r('sqrt(s2 * s22 / det / n)', 3)} AS stderr, {r('r2', 5)} AS pseudo_r2 FROM v
 UNION ALL SELECT l_returnflag, 'l_discount', {r('b2', 3)}, {r('sqrt(s2 * s11 / det / n)', 3)}, {r('r2', 5)} FROM v""")
def glm_two_predictor(spark, d):
    out = gaussian_glm(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", "feature", rnd("coef", 3).alias("coef"), rnd("stderr", 3).alias("stderr"),
                      rnd("pseudo_r2", 5).alias("pseudo_r2"))


@query("glm_wide", f"""WITH c AS (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i, label::DOUBLE AS y, vec_id FROM embeddings),
 m AS (SELECT vec_id, y, avg(x) AS x FROM c GROUP BY vec_id, y)
 SELECT 'score' AS feature, {r('covar_pop(x, y) / var_pop(x)', 4)} AS coef FROM m""")
def glm_wide(spark, d):
    """64 inputs that are one: the mean of each vector. The least solution has equal coefficients,
    and their sum is the slope of the mean."""
    v = table(spark, d, "embeddings").withColumn("x", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x) / F.size("embedding"))
    v = v.select(F.col("label").cast("double").alias("y"), *[F.col("x").alias(f"x{i}") for i in range(64)])
    return gaussian_glm(v, [f"x{i}" for i in range(64)], "y").agg(F.lit("score").alias("feature"), rnd(F.sum("coef"), 4).alias("coef"))


@query("glm_gated", f"""WITH g AS (SELECT event_type, covar_pop(user_id, value) AS c, var_pop(user_id) AS s, var_pop(value) AS v, count(*) AS n FROM events GROUP BY 1)
 SELECT event_type, 'user_id' AS feature, {r('CASE WHEN abs(c / s) / sqrt((v - c * c / s) / (n - 2) / s) < 1.959963984540054::DOUBLE THEN 0 ELSE c / s END')} AS coef FROM g""")
def glm_gated(spark, d):
    ev = table(spark, d, "events")
    return gaussian_glm(ev, ["user_id"], "value", ["event_type"], gate=True).select(
        "event_type", "feature", rnd("coef").alias("coef"))


@query("run_matrix", with_ctes("edges_v").rstrip() + """, sets AS (SELECT DISTINCT list_sort(list(child)) AS f FROM edges_v WHERE NOT (contains(child, 'cov_') OR contains(child, 'lbl_')) GROUP BY parent
  UNION SELECT DISTINCT list_sort(list(child)) FROM edges_v WHERE contains(child, 'cov_') OR contains(child, 'lbl_') GROUP BY parent),
 named AS (SELECT CASE WHEN starts_with(f[1], 'attr') THEN 'attr_' ELSE '' END || array_to_string(f, ', ') AS inp, f FROM sets)
 SELECT lbl AS out, inp, len(list_filter(f, lambda x: x <> lbl))::BIGINT AS n, typ AS type, trial FROM named, (VALUES ('lbl_F'), ('lbl_O')) l(lbl),
 (VALUES ('baseline'), ('downsample[cov_site]')) t(typ), (SELECT unnest(range(0, 3)) AS trial) WHERE NOT (len(f) = 1 AND f[1] = lbl)""")
def run_matrix_query(spark, d):
    sets = feature_sets(edges_v(spark, d), ["attr_subsets", "cov_subsets"])
    runs = run_matrix(sets, ["lbl_F", "lbl_O"], {"downsample": ["cov_site"]}, 3)
    return runs.select("out", "inp", F.size("features").cast("bigint").alias("n"), "type", "trial")


def _train_test(spark, d):
    df = stratified_holdout(scored(spark, d), "y", "id", 0.2)
    return df.where(F.col("part") == "train"), df.where(F.col("part") == "test")


def _classifier(kind, params=None, features=("z", "bal", "segment")):
    def run(spark, d):
        train, test = _train_test(spark, d)
        fitted = fit_model(train, list(features), "y", kind, params or {}, regression=False, seed=1)
        pred = predictions(fitted, {"train": train, "test": test}, "id")
        return pred.groupBy("eval_set").agg(
            F.count(F.lit(1)).alias("n"), F.avg((F.col("y") == (F.col("p") > 0.5).cast("int")).cast("double")).alias("accuracy"))

    return run


query("fit_logistic")(_classifier("LR"))
query("fit_logistic_l1")(_classifier("LR", {"penalty": "l1", "C": 0.1}))
query("fit_linear_svm")(_classifier("SVM"))
query("fit_forest")(_classifier("RF"))
# the default layers; 100 of the default 1,000 iterations
query("fit_perceptron")(_classifier("MLP", {"max_iter": 100}))


@query("fit_squared_hinge", f"""WITH m AS (SELECT avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag <> 'R') AS gap FROM lineitem)
 SELECT 'quantity' AS feature, {r('sign(gap) * 4 * 0.5 / (1 + 4 * 0.5)')} AS coef FROM m""")
def fit_squared_hinge(spark, d):
    """The mean quantities of returned and other lines are two points with a closed solution."""
    points = table(spark, d, "lineitem").groupBy((F.col("l_returnflag") == "R").cast("int").alias("y")).agg(F.avg("l_quantity").alias("quantity"))
    fitted = fit_model(points, ["quantity"], "y", "SVM", {"C": 0.5}, regression=False)
    return fitted.coefficient_table(spark).withColumn("coef", rnd("coef"))


@query("coefficient_table")
def coefficient_table(spark, d):
    train, _ = _train_test(spark, d)
    return fit_model(train, ["z", "bal", "segment"], "y", "LR", regression=False).coefficient_table(spark)


RIDGE_SQL = f"""WITH s AS (SELECT (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS x, l_extendedprice AS y FROM lineitem)
 SELECT 'l_quantity' AS feature, {r('covar_pop(x, y) / (var_pop(x) + 0.5)', 2)} AS coef FROM s"""


@query("fit_ridge", RIDGE_SQL)
def fit_ridge(spark, d):
    fitted = fit_model(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice", "LR", {"C": 2.0}, regression=True)
    return fitted.coefficient_table(spark).withColumn("coef", rnd("coef", 2))


@query("fit_lasso", RIDGE_SQL.replace("covar_pop(x, y) / (var_pop(x) + 0.5)", "greatest(covar_pop(x, y) - 100.0, 0) / var_pop(x)"))
def fit_lasso(spark, d):
    params = {"penalty": "l1", "alpha": 100.0}
    fitted = fit_model(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice", "LR", params, regression=True)
    return fitted.coefficient_table(spark).withColumn("coef", rnd("coef", 2))


@query("fit_forest_regressor")
def fit_forest_regressor(spark, d):
    train, test = _train_test(spark, d)
    fitted = fit_model(train, ["bal", "segment", "p"], "price", "RF", regression=True, seed=1)
    return fitted.predict(test, "pred").agg(F.corr("pred", "price").alias("corr"))


@query("baseline_fit")
def baseline_fit_query(spark, d):
    return baseline_fit(scored(spark, d), ["segment"], "y", "price", "id")


def _vectors(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("double").alias("label"))
    return stratified_holdout(v, "label", "vec_id", 0.2)


@query("pca_variances")
def pca_variances(spark, d):
    v = _vectors(spark, d)
    project = fit_pca(v.where(F.col("part") == "train"), "embedding", 3)
    cells = project(v).select("part", F.posexplode("pca").alias("component", "x"))
    return cells.groupBy("part", "component").agg(F.var_samp("x").alias("variance"))


@query("grid_search_logistic")
def grid_search(spark, d):
    v = _vectors(spark, d)
    train, test = v.where(F.col("part") == "train"), v.where(F.col("part") == "test")
    return reduced_grid_search(train, {"train": train, "test": test}, "embedding", "label", [3])


@query("estimate_associations")
def estimate_associations_query(spark, d):
    df = samples(spark, d).select("id", "status", "segment", "priority", "price", "bal")
    df = df.withColumn("lbl", F.when(F.col("status") == "F", "yes").otherwise("no"))
    scores, _ = estimate_associations(
        df, "id", ["lbl"], {"attr_all": ["price", "bal"], "cov_all": ["priority"]},
        {"test_all": df.withColumn("price", F.col("price") * 1.1)},
        {"downsample": ["segment"]}, metrics=("balanced_accuracy", "d2", "logodds_r2", "roc_auc"))
    return scores


# A saturated fit without penalty on one categorical input predicts the training group's means.
SATURATED = f"""WITH s AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice::DOUBLE AS price,
  (o_orderstatus = 'F')::INT AS y FROM orders),
 f AS (SELECT *, (row_number() OVER (PARTITION BY {{strata}} ORDER BY {h('id', "'42'")}, id) - 1) % 5 AS fold FROM s),
 t AS (SELECT unnest(range(5))::BIGINT AS trial), r AS (SELECT f.*, trial, CASE WHEN fold = trial THEN 'test' ELSE 'train' END AS eval_set FROM f, t)"""


def _saturated(spark, d, label, **options):
    df = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("price"), F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("flag"))
    found = estimate_associations(df, "id", [label], {"cov": ["priority"]}, params={"penalty": None}, seed="42", with_predictions=True, **options)
    return found


def _sums(found, value):
    """Per run, set and input group: rows and the mean prediction."""
    return found.scores.select(F.col("trial").cast("bigint").alias("trial"), "eval_set", "metric", rnd("value", value).alias("value"))


@query("estimate_numeric", SATURATED.format(strata="1") + f""",
 m AS (SELECT trial, priority, avg(price) AS p FROM r WHERE eval_set = 'train' GROUP BY 1, 2)
 SELECT trial, eval_set, 'r2' AS metric, {r('1 - sum((price - p) * (price - p)) / (count(*) * var_pop(price))', 4)} AS value FROM r JOIN m USING (trial, priority) GROUP BY 1, 2""")
def estimate_numeric(spark, d):
    return _sums(_saturated(spark, d, "price"), 4)


@query("estimate_binary", SATURATED.format(strata="y") + f""",
 m AS (SELECT trial, priority, avg(y) AS p FROM r WHERE eval_set = 'train' GROUP BY 1, 2)
 SELECT trial, eval_set, 'd2' AS metric, {r('1 - avg(-(y * ln(p) + (1 - y) * ln(1 - p))) / ln(2)', 3)} AS value FROM r JOIN m USING (trial, priority) GROUP BY 1, 2
 UNION ALL SELECT trial, eval_set, 'logodds_mae', {r('avg(abs(ln((0.01 + 0.98 * y) / (0.99 - 0.98 * y)) - ln(p / (1 - p))))', 2)} FROM r JOIN m USING (trial, priority) GROUP BY 1, 2""")
def estimate_binary(spark, d):
    got = _sums(_saturated(spark, d, "flag", metrics=("d2", "logodds_mae")), 6)
    return got.withColumn("value", F.when(F.col("metric") == "d2", rnd("value", 3)).otherwise(rnd("value", 2)))


@query("estimate_multiclass", SATURATED.format(strata="status") + f""",
 c AS (SELECT trial, priority, status, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY trial, priority) AS p FROM r WHERE eval_set = 'train' GROUP BY 1, 2, 3)
 SELECT trial, eval_set, 'd2' AS metric, {r('1 - avg(-ln(p)) / ln(3)', 3)} AS value FROM r JOIN c USING (trial, priority, status) GROUP BY 1, 2""")
def estimate_multiclass(spark, d):
    return _sums(_saturated(spark, d, "status", metrics=("d2",)), 3)


@query("run_predictions", SATURATED.format(strata="1") + f""",
 m AS (SELECT trial, priority, avg(price) AS p FROM r WHERE eval_set = 'train' GROUP BY 1, 2)
 SELECT trial, eval_set, id, price AS y, {r('p', 0)} AS p FROM r JOIN m USING (trial, priority)""")
def run_predictions(spark, d):
    pred = _saturated(spark, d, "price").predictions
    return pred.select(F.col("trial").cast("bigint").alias("trial"), "eval_set", "id", "y", rnd("p", 0).alias("p"))
