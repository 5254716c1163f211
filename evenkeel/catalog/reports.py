"""Queries over score, coefficient and importance reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.catalog.registry import query, r, rnd, u
from evenkeel.catalog.views import (
    names_v, rules_v, runs, samples, scored, scores, set_scores, spread_table, states_v, table,
    with_ctes,
)
from evenkeel.functions.names import effects_only, unpack_name
from evenkeel.functions.stats import expit
from evenkeel.plans import reports as P
from evenkeel.plans.effects import (
    Sources,
    attribute_effects,
    counterfactual_experiment,
    effect_scores,
    regression_effects,
)
from evenkeel.plans.models import gaussian_glm

PARTS = ["a_minus_dir", "a_minus_con", "a_none"]


def rounded(df, *cols, digits=6):
    return df.withColumns({c: rnd(c, digits) for c in cols})


@query("contrib_table", with_ctes("runs") + f"""SELECT out, inp, model || '(' || model_params || ')' AS model, type, regexp_extract(dataset, 'out/(.*)/train/', 1) AS dataset,
 {r('avg(score_test_d2)')} AS score_test_d2, {r('avg(score_none_d2)')} AS score_none_d2 FROM runs GROUP BY 1, 2, 3, 4, 5""")
def contrib_table(spark, d):
    return rounded(P.contrib_table(runs(spark, d)), "score_test_d2", "score_none_d2")


@query("contrib_table_pct", with_ctes("runs") + """SELECT out, inp, model || '(' || model_params || ')' AS model, type, regexp_extract(dataset, 'out/(.*)/train/', 1) AS dataset, trial,
 coalesce(trunc(100 * avg(score_test_d2))::BIGINT, -1) AS score_test_d2, coalesce(trunc(100 * avg(score_none_d2))::BIGINT, -1) AS score_none_d2
 FROM runs WHERE trial IN (0, 1, 2) GROUP BY ALL""")
def contrib_table_pct(spark, d):
    return P.contrib_table(runs(spark, d), avg_over_trials=False, filter_rows={"trial": [0, 1, 2]}, percentages=True)


@query("ood_scores", with_ctes("piv_d2") + f"""SELECT dataset, trial, {r('(a_total - a_minus_dir) / nullif(a_total - a_none, 0)', 5)} AS a_dir,
 {r('(a_total - a_minus_con) / nullif(a_total - a_none, 0)', 5)} AS a_con FROM piv_d2""")
def ood_scores(spark, d):
    out = P.ood_scores(set_scores(spark, d, "d2"))
    return rounded(out, "a_dir", "a_con", digits=5).select("dataset", "trial", "a_dir", "a_con")


@query("score_drop", with_ctes("piv_logodds_mse") + f"""SELECT dataset, trial, {r('abs(a_total - a_minus_dir) / a_total')} AS a_minus_dir,
 {r('abs(a_total - a_minus_con) / a_total')} AS a_minus_con, {r('abs(a_total - a_none)')} AS a_none FROM piv_logodds_mse""")
def score_drop(spark, d):
    out = P.score_drop(set_scores(spark, d, "logodds_mse"), PARTS, "logodds_mse")
    return rounded(out, *PARTS).drop("a_total")


@query("score_drop_accuracy", with_ctes("piv_balanced_accuracy") + f"""SELECT dataset, trial, {r('abs(100 * a_total - 100 * a_minus_dir) + 50')} AS a_minus_dir,
 {r('abs(100 * a_total - 100 * a_minus_con) + 50')} AS a_minus_con FROM piv_balanced_accuracy""")
def score_drop_accuracy(spark, d):
    df = set_scores(spark, d, "balanced_accuracy")
    df = df.withColumns({c: 100 * F.col(c) for c in ("a_total", "a_minus_dir", "a_minus_con")})
    out = P.score_drop(df, PARTS[:2], "balanced_accuracy")
    return rounded(out, *PARTS[:2]).select("dataset", "trial", *PARTS[:2])


@query("score_sum", with_ctes("piv_balanced_accuracy") + f"""SELECT dataset, trial, {r('coalesce(100 * a_minus_dir, 0) + coalesce(100 * a_minus_con, 0) - 50')} AS a_sum FROM piv_balanced_accuracy""")
def score_sum(spark, d):
    df = set_scores(spark, d, "balanced_accuracy")
    df = df.withColumns({c: 100 * F.col(c) for c in PARTS})
    return rounded(P.score_sum(df, PARTS[:2], "balanced_accuracy"), "a_sum").select("dataset", "trial", "a_sum")


@query("score_mean_2std", with_ctes("scores") + f"""SELECT dataset, eval_set, metric, {r('avg(value)')} AS mean, {r('2 * stddev_samp(value)')} AS two_std FROM scores GROUP BY 1, 2, 3""")
def score_mean_2std(spark, d):
    return rounded(P.mean_two_std(scores(spark, d), ["dataset", "eval_set", "metric"], "value"), "mean", "two_std")


@query("score_parts", with_ctes("piv_d2") + f"""SELECT dataset, part, {r('avg(v)')} AS mean FROM (UNPIVOT (SELECT dataset, a_minus_dir, a_minus_con,
 CASE WHEN dataset <> 'BUILDING' THEN a_none END AS a_none FROM piv_d2) ON a_minus_dir, a_minus_con, a_none INTO NAME part VALUE v) GROUP BY 1, 2""")
def score_parts(spark, d):
    df = set_scores(spark, d, "d2").withColumn("a_none", F.when(F.col("dataset") != "BUILDING", F.col("a_none")))
    return rounded(P.part_means(df, ["dataset"], PARTS), "mean")


@query("score_center", with_ctes("piv_balanced_accuracy", "piv_d2") + f"""SELECT a.dataset, a.trial,
 {r('a.a_total * (CASE WHEN max(a.a_total) OVER () <= 1 THEN 100 ELSE 1 END) - 50')} AS acc,
 {r('greatest(d.a_none * (CASE WHEN max(d.a_none) OVER () <= 1 THEN 100 ELSE 1 END), 0)')} AS d2 FROM piv_balanced_accuracy a JOIN piv_d2 d USING (dataset, trial)""")
def score_center(spark, d):
    acc = P.center_scores(set_scores(spark, d, "balanced_accuracy"), ["a_total"], "balanced_accuracy")
    d2 = P.center_scores(set_scores(spark, d, "d2"), ["a_none"], "d2")
    both = acc.select("dataset", "trial", rnd("a_total").alias("acc"))
    return both.join(d2.select("dataset", "trial", rnd("a_none").alias("d2")), ["dataset", "trial"])


@query("true_effects", with_ctes("names_v") + f"""SELECT name, {r('ln((cX / 100.0::DOUBLE) / (1 - cX / 100.0::DOUBLE))')} AS alpha_true,
 {r('ln((cy / 100.0::DOUBLE) / (1 - cy / 100.0::DOUBLE))')} AS gamma_true, {r('ln((Xy / 100.0::DOUBLE) / (1 - Xy / 100.0::DOUBLE))')} AS beta_true FROM names_v""")
def true_effects(spark, d):
    parsed = names_v(spark, d).select("name", unpack_name(F.col("name")).alias("f"))
    df = parsed.select("name", F.col("f.cX").alias("cX"), F.col("f.cys")[0].alias("cy"), F.col("f.Xy").alias("Xy"))
    out = P.true_effects(df)
    return rounded(out, "alpha_true", "gamma_true", "beta_true").drop("cX", "cy", "Xy")


@query("pack_name", with_ctes("names_v") + """SELECT direct, n AS n_cons, "cX", cy, "Xy", suffix, name FROM names_v""")
def pack_name_query(spark, d):
    return names_v(spark, d).select("direct", F.size("cons").alias("n_cons"), "cX", "cy", "Xy", "suffix", "name")


@query("unpack_name", with_ctes("names_v") + """SELECT name, n::BIGINT AS n, replace(direct, 'lat_' || flag || '_vol', 'lat-' || flag || '_vol') AS direct,
 CASE WHEN n = 2 THEN 'cov_1_cat2|cov_2_cont' ELSE 'cov_1_cat2' END AS cons, "cX"::DOUBLE AS "cX", cy::DOUBLE AS cy1, CASE WHEN n = 2 THEN (cy + 10)::DOUBLE END AS cy2,
 "Xy"::DOUBLE AS "Xy", suffix, true AS valid FROM names_v""")
def unpack_name_query(spark, d):
    named = names_v(spark, d).select("name", F.concat(F.lit("run_n500_"), "name").alias("full"))
    f = named.select("name", unpack_name(F.col("full"), prefix=r"run_n\d+_").alias("f"))
    return f.select("name", "f.n", "f.direct", F.array_join("f.cons", "|").alias("cons"), "f.cX",
                    F.get("f.cys", F.lit(0)).alias("cy1"), F.get("f.cys", F.lit(1)).alias("cy2"), "f.Xy", "f.suffix", "f.valid")


@query("dataset_families", with_ctes("names_v") + r"""SELECT DISTINCT regexp_replace(name, '(cX|c[0-9]*y|Xy)[0-9]+', '\1***', 'g') AS family FROM names_v""")
def dataset_families(spark, d):
    return P.dataset_families(names_v(spark, d))


@query("effect_order", with_ctes("names_v") + f"""SELECT DISTINCT "cX", cy, "Xy", regexp_extract(name, 'cX.*', 0) AS effects, dense_rank() OVER (ORDER BY "Xy", cy, "cX") AS position,
 {r('Xy + cy / 100.0::DOUBLE + cX / 10000.0::DOUBLE')} AS sort_value FROM names_v""")
def effect_order(spark, d):
    df = names_v(spark, d).select("cX", "cy", "Xy", effects_only(F.col("name")).alias("effects")).distinct()
    return rounded(P.effect_order(df, "cX", "cy", "Xy"), "sort_value")


@query("change_points", with_ctes("names_v") + """, c AS (SELECT DISTINCT "cX", cy, "Xy" FROM names_v), l AS (SELECT *, row_number() OVER w AS position, lag("Xy") OVER w AS px, lag(cy) OVER w AS pc
 FROM c WINDOW w AS (ORDER BY "Xy", cy, "cX"))
 SELECT position, "Xy", cy, (px IS NULL OR px <> "Xy") AS "Xy_changed", (pc IS NULL OR pc <> cy) AS cy_changed FROM l""")
def change_points(spark, d):
    combos = P.effect_order(names_v(spark, d).select("cX", "cy", "Xy").distinct(), "cX", "cy", "Xy")
    return P.change_points(combos, "position", ["Xy", "cy"]).select("position", "Xy", "cy", "Xy_changed", "cy_changed")


def segment_coefs(spark, d):
    df = scored(spark, d)
    return gaussian_glm(df, ["bal", "z"], "logit", ["segment", "fold"])


COEFS = with_ctes("scored").rstrip() + """,
 g AS (SELECT segment, fold, count(*) AS n, covar_pop(bal, bal) AS s11, covar_pop(bal, z) AS s12, covar_pop(z, z) AS s22, covar_pop(bal, logit) AS c1, covar_pop(z, logit) AS c2, var_pop(logit) AS vy FROM scored GROUP BY 1, 2),
 b AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * c1 - s12 * c2) / (s11 * s22 - s12 * s12) AS b1, (s11 * c2 - s12 * c1) / (s11 * s22 - s12 * s12) AS b2 FROM g),
 v AS (SELECT *, n * (vy - b1 * c1 - b2 * c2) / (n - 3) / n / det AS k FROM b),
 coefs AS (SELECT segment, fold, 'bal' AS feature, b1 AS coef, sqrt(k * s22) AS stderr FROM v UNION ALL SELECT segment, fold, 'z', b2, sqrt(k * s11) FROM v)
"""


@query("coef_avg", COEFS + f"SELECT segment, feature, {r('avg(coef)', 7)} AS coef, {r('avg(stderr)', 7)} AS stderr FROM coefs GROUP BY 1, 2")
def coef_avg(spark, d):
    return rounded(P.average_coefs(segment_coefs(spark, d), ["segment"]), "coef", "stderr", digits=7)


@query("coef_gate", COEFS + f"""SELECT segment, fold, feature, {r('CASE WHEN abs(coef / stderr) < 1.959963984540054::DOUBLE THEN 0 ELSE coef END', 7)} AS coef FROM coefs""")
def coef_gate(spark, d):
    return rounded(P.gate_coefs(segment_coefs(spark, d)), "coef", digits=7).select("segment", "fold", "feature", "coef")


@query("coef_roles", COEFS + f"""SELECT segment, fold, '$\\hat{{\\beta}}$ from z (z)' AS label, {r('coef', 7)} AS coef FROM coefs WHERE feature = 'z'""")
def coef_roles(spark, d):
    roles = spark.createDataFrame([("z", "direct"), ("region", "confounder")], "var string, role string")
    out = P.label_coefs(segment_coefs(spark, d), roles, " from z", hat=True)
    return rounded(out, "coef", digits=7).select("segment", "fold", "label", "coef")


@query("coef_band", COEFS + f"""SELECT segment, fold, feature, {r('coef - 1.96 * stderr', 7)} AS lower, {r('coef + 1.96 * stderr', 7)} AS upper FROM coefs""")
def coef_band(spark, d):
    return rounded(P.coef_band(segment_coefs(spark, d)), "lower", "upper", digits=7).select("segment", "fold", "feature", "lower", "upper")


SHARES = with_ctes("piv_d2").rstrip() + """,
 s AS (SELECT *, (a_total - a_minus_dir) / nullif(a_total - a_none, 0) AS a_dir, (a_total - a_minus_con) / nullif(a_total - a_none, 0) AS a_con FROM piv_d2),
 sh AS (SELECT *, a_minus_con / (a_minus_con + a_minus_dir + 1e-6::DOUBLE) AS beta_share, a_minus_dir / (a_minus_con + a_minus_dir + 1e-6::DOUBLE) AS gamma_share FROM s)
"""


def shared(spark, d):
    return P.effect_share(P.ood_scores(set_scores(spark, d, "d2")), "a_minus_con", "a_minus_dir")


@query("effect_share", SHARES + f"""SELECT dataset, trial, {r('beta_share', 5)} AS beta_share, {r('gamma_share', 5)} AS gamma_share,
 {r('a_minus_dir / (beta_share + a_minus_dir + 1e-6::DOUBLE)', 5)} AS gamma_compat FROM sh""")
def effect_share(spark, d):
    base = set_scores(spark, d, "d2")
    both = P.effect_share(base, "a_minus_con", "a_minus_dir", compat=True).withColumnRenamed("gamma_share", "gamma_compat")
    out = P.effect_share(both.drop("beta_share"), "a_minus_con", "a_minus_dir")
    return rounded(out, "beta_share", "gamma_share", "gamma_compat", digits=5).select(
        "dataset", "trial", "beta_share", "gamma_share", "gamma_compat")


@query("effect_deviation", SHARES + f"""SELECT dataset, trial, {r('abs(a_dir - beta_share)', 5)} AS dev_dir, {r('abs(a_con - gamma_share)', 5)} AS dev_con FROM sh""")
def effect_deviation(spark, d):
    out = P.effect_deviation(shared(spark, d))
    return rounded(out, "dev_dir", "dev_con", digits=5).select("dataset", "trial", "dev_dir", "dev_con")


def _avg_rank(col: str) -> str:
    return f"rank() OVER (ORDER BY {col}) + (count(*) OVER (PARTITION BY {col}) - 1) / 2.0::DOUBLE"


@query("spearman_matrix", f"""WITH k AS (SELECT {_avg_rank('l_quantity')} AS q, {_avg_rank('l_extendedprice')} AS e, {_avg_rank('l_discount')} AS dc, {_avg_rank('l_tax')} AS t FROM lineitem)
 SELECT 'l_quantity' AS "column", 'l_discount' AS against, {r('abs(corr(q, dc))', 7)} AS rho FROM k UNION ALL SELECT 'l_quantity', 'l_tax', {r('abs(corr(q, t))', 7)} FROM k
 UNION ALL SELECT 'l_extendedprice', 'l_discount', {r('abs(corr(e, dc))', 7)} FROM k UNION ALL SELECT 'l_extendedprice', 'l_tax', {r('abs(corr(e, t))', 7)} FROM k""")
def spearman_matrix(spark, d):
    out = P.spearman(spread_table(spark, d, "lineitem", "l_quantity", "l_extendedprice", "l_discount", "l_tax"), ["l_quantity", "l_extendedprice"], ["l_discount", "l_tax"])
    return rounded(out, "rho", digits=7)


@query("top_features", f"""WITH m AS (SELECT lang, doc_id, unnest(['len', 'words', 'lines', 'quality', 'vowels']) AS feature,
  unnest([n_chars::DOUBLE, doc_id::DOUBLE, length(source)::DOUBLE * 50, 100.0::DOUBLE, (n_chars + doc_id)::DOUBLE / 2]) AS value FROM documents),
 s AS (SELECT *, value / sum(value) OVER (PARTITION BY doc_id) AS share FROM m), a AS (SELECT lang, feature, avg(share) AS share FROM s GROUP BY 1, 2)
 SELECT lang, feature, {r('abs(share)')} AS share FROM a QUALIFY row_number() OVER (PARTITION BY lang ORDER BY share DESC, feature) <= 3""")
def top_features(spark, d):
    n, i = F.col("n_chars").cast("double"), F.col("doc_id").cast("double")
    maps = F.create_map(F.lit("len"), n, F.lit("words"), i, F.lit("lines"), F.length("source").cast("double") * 50,
                        F.lit("quality"), F.lit(100.0), F.lit("vowels"), (n + i) / 2)
    docs = table(spark, d, "documents").select("lang", "doc_id", maps.alias("importance"))
    return rounded(P.top_features(docs, ["lang"], ["doc_id"], 3), "share")


@query("column_profile", """SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS n_distinct, false AS numeric, 'bar' AS chart FROM orders
 UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice), true, CASE WHEN count(DISTINCT round_even(o_totalprice, 1)) < 10 THEN 'bar' ELSE 'hist' END FROM orders
 UNION ALL SELECT 'y', count(DISTINCT o_orderstatus = 'F'), true, 'pie' FROM orders
 UNION ALL SELECT 'k', count(DISTINCT o_orderkey % 7), true, 'bar' FROM orders""")
def column_profile(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderstatus", "o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_orderkey") % 7).alias("k"))
    return P.column_profile(o, o.columns)


@query("value_counts", "SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1")
def value_counts(spark, d):
    return P.value_counts(table(spark, d, "lineitem"), "l_quantity")


@query("histogram", f"""WITH v AS (SELECT round_even(value, 1) AS v FROM events), s AS (SELECT min(v) AS lo, max(v) AS hi, greatest(count(DISTINCT v) // 5, 1) AS k FROM v),
 b AS (SELECT least(floor((v - lo) / ((hi - lo) / k)), k - 1)::BIGINT AS bin, lo, (hi - lo) / k AS w FROM v, s)
 SELECT bin, {r('lo + bin * w')} AS "left", count(*) AS n FROM b GROUP BY bin, lo, w""")
def histogram(spark, d):
    return rounded(P.histogram(table(spark, d, "events"), "value"), "left")


@query("cond_density", with_ctes("samples") + f""", lim AS (SELECT min(price) AS lo, max(price) AS hi FROM samples),
 st AS (SELECT segment, count(*) AS n, stddev_samp(price) * pow(count(*)::DOUBLE, -0.2::DOUBLE) * 3 AS hh FROM samples GROUP BY 1),
 g AS (SELECT i AS point, lo + i * ((hi - lo) / 9) AS x FROM lim, (SELECT unnest(range(0, 10)) AS i))
 SELECT s.segment, point, {r('x', 3)} AS x, {r('1e6::DOUBLE * sum(exp(-pow((x - price) / hh, 2) / 2)) / (any_value(n) * any_value(hh) * sqrt(2 * pi()))')} AS density
 FROM samples s JOIN st USING (segment), g GROUP BY s.segment, point, x""")
def cond_density(spark, d):
    out = P.conditional_density(samples(spark, d).select("segment", "price"), "price", ["segment"])
    return out.withColumns({"x": rnd("x", 3), "density": rnd(F.col("density") * 1e6)})


@query("unpivot_scores", with_ctes("piv_d2") + f"""SELECT dataset, trial, score, {r('v')} AS value FROM (UNPIVOT piv_d2 ON a_total, a_none, a_minus_dir, a_minus_con INTO NAME score VALUE v)""")
def unpivot_scores(spark, d):
    return rounded(P.unpivot_scores(set_scores(spark, d, "d2"), ["dataset", "trial"], ["a_total", "a_none", "a_minus_dir", "a_minus_con"]), "value")


@query("pivot_metrics", with_ctes("ev") + f"""SELECT dataset, trial, {r("max(CASE WHEN eval_set = 'test_all' THEN d2 END)")} AS "d2 | test_all", {r("max(CASE WHEN eval_set = 'test_none' THEN d2 END)")} AS "d2 | test_none",
 {r("max(CASE WHEN eval_set = 'test_all' THEN logodds_r2 END)")} AS "logodds_r2 | test_all", {r("max(CASE WHEN eval_set = 'test_none' THEN logodds_r2 END)")} AS "logodds_r2 | test_none" FROM ev GROUP BY 1, 2""")
def pivot_metrics(spark, d):
    per_set = scores(spark, d).groupBy("dataset", "trial", "eval_set").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    nested = per_set.groupBy("dataset", "trial").agg(
        F.map_from_entries(F.collect_list(F.struct("eval_set", "m"))).alias("scores"))
    out = P.pivot_metrics(nested, ["dataset", "trial"], "scores", ["test_none", "test_all"], ["logodds_r2", "d2"])
    return out.select("dataset", "trial", *[rnd(f"`{c}`").alias(c) for c in out.columns[2:]])


@query("minmax_row", f"""SELECT l_orderkey, l_linenumber::BIGINT AS line, {r('(a - least(a, b, c)) / nullif(greatest(a, b, c) - least(a, b, c), 0)')} AS a, {r('(b - least(a, b, c)) / nullif(greatest(a, b, c) - least(a, b, c), 0)')} AS b,
 {r('(c - least(a, b, c)) / nullif(greatest(a, b, c) - least(a, b, c), 0)')} AS c FROM (SELECT *, l_discount AS a, l_tax AS b, l_quantity / 500 AS c FROM lineitem)""")
def minmax_row(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"),
                                            F.col("l_discount").alias("a"), F.col("l_tax").alias("b"), (F.col("l_quantity") / 500).alias("c"))
    return rounded(P.minmax_row(li, "^[abc]$"), "a", "b", "c")


@query("best_checkpoint", """SELECT user_id, max(value) AS loss, min(event_id) FILTER (value = top) AS event_id FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS top FROM events) GROUP BY 1""")
def best_checkpoint(spark, d):
    ev = table(spark, d, "events").withColumnRenamed("value", "loss")
    return P.best_checkpoint(ev, ["user_id"], "loss", "event_id", "max")


@query("mean_ci", f"""SELECT lang, source, {r('avg(n_chars)', 4)} AS mean, {r('avg(n_chars) - 1.96 * stddev_samp(n_chars) / sqrt(count(n_chars))', 4)} AS lower,
 {r('avg(n_chars) + 1.96 * stddev_samp(n_chars) / sqrt(count(n_chars))', 4)} AS upper FROM documents GROUP BY 1, 2""")
def mean_ci(spark, d):
    return rounded(P.mean_ci(table(spark, d, "documents"), ["lang", "source"], "n_chars"), "mean", "lower", "upper", digits=4)


_BOOT_WEIGHT = "(" + " + ".join(f"(u > {c!r}::DOUBLE)::INT" for c in P.POISSON_CDF) + ")"


@query("bootstrap_ci", f"""WITH h AS (SELECT event_type, value, k, md5(event_id::VARCHAR || ':boot' || k || ':42') AS h FROM events, (SELECT unnest(range(50)) AS k)),
 e AS (SELECT event_type, value, k, j, ('0x' || substr(h, 8 * j + 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM h, (SELECT unnest(range(4)) AS j)),
 b AS (SELECT event_type, sum({_BOOT_WEIGHT} * value) / sum({_BOOT_WEIGHT}) AS m FROM e GROUP BY event_type, k, j),
 s AS (SELECT event_type, list(m ORDER BY m) AS l FROM b GROUP BY 1), a AS (SELECT event_type, avg(value) AS mean FROM events GROUP BY 1)
 SELECT event_type, {r('mean')} AS mean, {r('l[5]')} AS lower, {r('l[195]')} AS upper FROM s JOIN a USING (event_type)""")
def bootstrap_ci(spark, d):
    out = P.bootstrap_ci(spread_table(spark, d, "events", "event_id", "event_type", "value"), ["event_type"], "value", "event_id", seed="42")
    return rounded(out, "mean", "lower", "upper")


@query("metrics_todo", """SELECT DISTINCT user_id, event_type FROM (SELECT user_id, t.event_type FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (SELECT DISTINCT event_type FROM events) t)
 EXCEPT SELECT user_id, event_type FROM events WHERE value > 100""")
def metrics_todo(spark, d):
    ev = table(spark, d, "events")
    from evenkeel.operators.features import categories

    kinds = F.array(*[F.lit(k) for k in categories(ev, "event_type")])
    wanted = ev.select("user_id").distinct().withColumn("event_type", F.explode(kinds))
    return P.metrics_todo(wanted, ev.where(F.col("value") > 100), ["user_id", "event_type"])


@query("zip_predictions", f"""SELECT vec_id, (pos - 1)::BIGINT AS pos, {r('embedding[pos]')} AS truth, {r('embedding[pos] * embedding[pos]')} AS score
 FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS pos FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings))""")
def zip_predictions(spark, d):
    packed = table(spark, d, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("y_true")).withColumn(
        "y_pred", F.transform("y_true", lambda x: x * x))
    return rounded(P.zip_predictions(packed, ["vec_id"], ["y_true", "y_pred"], ["truth", "score"]), "truth", "score")


@query("join_predictions", """SELECT conv_id, turn, role AS truth, length(text)::BIGINT AS score FROM conversations""")
def join_predictions(spark, d):
    c = table(spark, d, "conversations")
    truth = c.select("conv_id", "turn", F.col("role").alias("truth"))
    pred = c.select("conv_id", "turn", F.length("text").cast("bigint").alias("score"))
    return P.join_predictions(truth, pred, ["conv_id", "turn"])


@query("effect_density", f"""WITH s AS (SELECT '[' || least(cy, xy) || ', ' || greatest(cy, xy) || ']' AS pair, p FROM (
  SELECT round(l_tax * 25)::BIGINT AS cy, round(l_discount * 20)::BIGINT AS xy, 1 / (1 + exp(-(l_quantity - 25) / 10)) AS p FROM lineitem)),
 lim AS (SELECT min(p) AS lo, max(p) AS hi FROM s), st AS (SELECT pair, count(*) AS n, stddev_samp(p) * pow(count(*)::DOUBLE, -0.2::DOUBLE) AS hh FROM s GROUP BY 1),
 g AS (SELECT i AS point, lo + i * ((hi - lo) / 9) AS x FROM lim, (SELECT unnest(range(0, 10)) AS i))
 SELECT s.pair, point, {r('x')} AS x, {r('sum(exp(-pow((x - p) / hh, 2) / 2)) / (any_value(n) * any_value(hh) * sqrt(2 * pi()))')} AS density
 FROM s JOIN st USING (pair), g GROUP BY s.pair, point, x""")
def effect_density(spark, d):
    li = table(spark, d, "lineitem")
    pair = P.effect_pair(F.round(F.col("l_tax") * 25).cast("bigint"), F.round(F.col("l_discount") * 20).cast("bigint"))
    df = li.select(pair.alias("pair"), expit((F.col("l_quantity") - 25) / 10).alias("p"))
    return rounded(P.conditional_density(df, "p", ["pair"], adjust=1.0), "x", "density")


@query("cf_pair_diff", with_ctes("scored") + f""", s AS (SELECT id, segment, least(greatest(p, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p, least(greatest(1 / (1 + exp(-z * 0.4::DOUBLE)), 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS q FROM scored)
 SELECT segment, id, {r('ln(p / (1 - p)) - ln(q / (1 - q))', 10)} AS effect FROM s""")
def cf_pair_diff(spark, d):
    s = scored(spark, d)
    base = s.select("id", "segment", "p", F.lit("test_all").alias("eval_set"))
    other = s.select("id", "segment", expit(F.col("z") * 0.4).alias("p"), F.lit("test_with_con").alias("eval_set"))
    out = P.counterfactual_gap(base.unionByName(other), "id", "test_all", "test_with_con", by=["segment"])
    return rounded(out, "effect", digits=10).select("segment", "id", "effect")




SOURCES = Sources(direct=("z",), confounders=("bal",))


@query("effect_scores", with_ctes("ev").rstrip() + f""",
 w AS (SELECT dataset, metric, avg(CASE WHEN eval_set = 'test_all' THEN v END) AS t, avg(CASE WHEN eval_set = 'test_none' THEN v END) AS n,
  avg(CASE WHEN eval_set = 'test_with_con' THEN v END) AS d, avg(CASE WHEN eval_set = 'test_with_dir' THEN v END) AS c
  FROM (UNPIVOT (SELECT dataset, eval_set, d2, logodds_r2 FROM ev) ON d2, logodds_r2 INTO NAME metric VALUE v) GROUP BY 1, 2)
 SELECT dataset, metric, {r('t')} AS a_total, {r('n')} AS a_none, {r('d')} AS a_minus_dir, {r('c')} AS a_minus_con,
 {r('(t - d) / nullif(t - n, 0)', 5)} AS a_dir, {r('(t - c) / nullif(t - n, 0)', 5)} AS a_con FROM w""")
def effect_scores_query(spark, d):
    long = scores(spark, d).where(F.col("metric").isin("d2", "logodds_r2"))
    out = effect_scores(long, Sources(direct=("dir",), confounders=("con",)))
    return rounded(rounded(out, "a_total", "a_none", "a_minus_dir", "a_minus_con"), "a_dir", "a_con", digits=5)


@query("regression_effects", with_ctes("scored").rstrip() + f""",
 sd AS (SELECT stddev_pop(z) AS sz, stddev_pop(bal) AS sb FROM scored),
 lo AS (SELECT fold, z / sz AS x1, bal / sb AS x2, ln(p / (1 - p)) AS t FROM scored, sd),
 g AS (SELECT fold, count(*) AS n, covar_pop(x1, x1) AS s11, covar_pop(x1, x2) AS s12, covar_pop(x2, x2) AS s22, covar_pop(x1, t) AS c1, covar_pop(x2, t) AS c2, var_pop(t) AS vy FROM lo GROUP BY 1),
 b AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * c1 - s12 * c2) / (s11 * s22 - s12 * s12) AS b1, (s11 * c2 - s12 * c1) / (s11 * s22 - s12 * s12) AS b2 FROM g),
 e AS (SELECT *, n * (vy - b1 * c1 - b2 * c2) / (n - 3) / n / det AS k, 1 - (vy - b1 * c1 - b2 * c2) / vy AS r2 FROM b),
 c AS (SELECT 'z_z' AS feature, 'direct' AS role, b1 AS coef, sqrt(k * s22) AS se, r2 FROM e UNION ALL SELECT 'bal_z', 'confounder', b2, sqrt(k * s11), r2 FROM e)
 SELECT 'gamma' AS model, feature, role, {r('avg(CASE WHEN abs(coef / se) < 1.959963984540054::DOUBLE THEN 0 ELSE coef END)')} AS coef, {r('avg(se)')} AS stderr, {r('avg(r2)')} AS pseudo_r2 FROM c GROUP BY 2, 3""")
def regression_effects_query(spark, d):
    out = regression_effects(scored(spark, d), "p", SOURCES, "fold")
    return rounded(out, "coef", "stderr", "pseudo_r2")


@query("attribute_effects")
def attribute_effects_query(spark, d):
    out = attribute_effects(scored(spark, d), scores(spark, d), Sources(("z",), ("bal",)), "p", "fold")
    return out


@query("counterfactual_experiment")
def counterfactual_experiment_query(spark, d):
    """Rules learned from the samples, drawn for every order, fit and scored everywhere."""
    ids = samples(spark, d).select("id")
    study = counterfactual_experiment(
        ids, states_v(spark, d), rules_v(spark, d), "id", "lbl_y", Sources(("priority",), ("segment",)),
        ["priority", "attr"], metrics=["d2", "balanced_accuracy"])
    return study.scores
