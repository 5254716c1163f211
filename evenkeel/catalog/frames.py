"""Queries over column selection, filters and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.catalog.registry import query, r, rnd
from evenkeel.catalog.views import edges_v, samples, scores, set_scores, table, with_ctes
from evenkeel.functions.text import basename, replace_chain, symbol_label
from evenkeel.operators.contracts import (
    all_violations,
    cardinality_violations,
    class_count_violations,
    duplicate_violations,
    group_class_violations,
    unique_ratio_violations,
)
from evenkeel.operators.frames import (
    clip_lower,
    columns_by_role,
    drop_null,
    feature_sets,
    filter_allowed,
    select_matching,
    sort_columns,
)
from evenkeel.operators.metrics import score_wide
from evenkeel.plans.reports import identifiable, rename_scores


def role_table(spark, d):
    """Samples with role-prefixed column names."""
    return samples(spark, d).select(
        "id", F.col("status").alias("lbl_status"), F.col("segment").alias("cov_segment"),
        F.col("region").alias("cov_region"), F.col("price").alias("brain_price"), F.col("bal").alias("brain_bal"))


@query("select_roles", with_ctes("samples") + f"""SELECT id, status AS lbl_status, segment AS cov_segment,
 region AS cov_region, {r('bal', 2)} AS brain_bal FROM samples""")
def select_roles(spark, d):
    df = role_table(spark, d)
    roles = columns_by_role(df, "id")
    picked = df.select("id", *roles.labels, *roles.covariates, *roles.attributes)
    out = select_matching(picked, r"^(?!.*price)", keep=["id"])
    return out.withColumn("brain_bal", rnd("brain_bal", 2))


FEATURE_SETS_SQL = with_ctes("edges_v") + """, kids AS (
 SELECT parent, child, (contains(child, 'cov_') OR contains(child, 'lbl_')) AS c FROM edges_v),
 sub AS (SELECT DISTINCT CASE WHEN c THEN 'cov_subsets' ELSE 'attr_subsets' END AS kind,
  list_sort(list(child)) AS f, c FROM kids GROUP BY parent, c),
 allsets AS (SELECT kind, CASE WHEN c THEN '' ELSE 'attr_' END || array_to_string(f, ', ') AS name, f FROM sub
  UNION ALL SELECT 'attr_superset', 'attr_superset', list_sort(list(DISTINCT child)) FROM kids WHERE NOT c)
 SELECT kind, name, array_to_string(list_filter(f, lambda x: x <> 'lbl_F'), '|') AS features,
  len(list_filter(f, lambda x: x <> 'lbl_F'))::BIGINT AS n FROM allsets"""


@query("feature_sets", FEATURE_SETS_SQL)
def feature_sets_query(spark, d):
    sets = feature_sets(edges_v(spark, d), ["attr_subsets", "cov_subsets", "attr_superset"], "lbl_F")
    return sets.select("kind", "name", F.array_join("features", "|").alias("features"),
                       F.size("features").cast("bigint").alias("n"))


@query("filter_allowed", """SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)
 WHERE (lang IN ('en', 'de')) AND (quality IN (1) OR quality IS NULL)""")
def filter_allowed_query(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    df = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return filter_allowed(df, {"lang": ["en", "de"], "quality": [1, None]})


@query("drop_null", """SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL""")
def drop_null_query(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    df = docs.join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")
    return drop_null(drop_null(df, ["quality"]), ["quality", "toxic"], how="all")


@query("clip_scores", with_ctes("piv_logodds_r2") + f"""SELECT dataset, trial, {r('greatest(a_total, 0)')} AS a_total,
 {r('greatest(a_none, 0)')} AS a_none FROM piv_logodds_r2""")
def clip_scores(spark, d):
    df = clip_lower(set_scores(spark, d), ["a_total", "a_none"])
    return df.select("dataset", "trial", rnd("a_total").alias("a_total"), rnd("a_none").alias("a_none"))


@query("rename_scores", with_ctes("piv_d2") + f"""SELECT dataset, trial, {r('a_total')} AS "A_total", {r('a_none')} AS "A_none",
 {r('a_minus_con')} AS "A_true1", {r('a_minus_dir')} AS "A_con1(con)" FROM piv_d2""")
def rename_scores_query(spark, d):
    wide = score_wide(scores(spark, d), ["dataset", "trial"],
                      ["test_all", "test_none", "test_with_dir", "test_with_con"], ["d2"])
    out = rename_scores(wide, "d2", ["dir"], ["con"])
    return out.select("dataset", "trial", *[rnd(f"`{c}`").alias(c) for c in out.columns[2:]])


@query("sort_columns", """SELECT n_name AS a_name, n_regionkey::BIGINT AS b_region, r_name AS c_region_name, count(c_custkey) AS d_customers
 FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2, 3""")
def sort_columns_query(spark, d):
    n, rg, c = (table(spark, d, t) for t in ("nation", "region", "customer"))
    joined = n.join(rg, n.n_regionkey == rg.r_regionkey).join(c, c.c_nationkey == n.n_nationkey, "left")
    counts = joined.groupBy("n_name", "n_regionkey", "r_name").agg(F.count("c_custkey").alias("d_customers"))
    return sort_columns(counts.select(
        "d_customers", F.col("r_name").alias("c_region_name"), F.col("n_name").alias("a_name"),
        F.col("n_regionkey").cast("bigint").alias("b_region")))


@query("contract_violations", with_ctes("samples") + """
 SELECT 'confound_cardinality' AS "check", 'day' AS subject, count(DISTINCT o_orderdate::DATE)::DOUBLE AS value FROM orders
  HAVING count(DISTINCT o_orderdate::DATE) NOT BETWEEN 2 AND 10
 UNION ALL SELECT 'confound_cardinality', 'source', count(DISTINCT source)::DOUBLE FROM documents HAVING count(DISTINCT source) NOT BETWEEN 2 AND 10
 UNION ALL SELECT 'single_class', source || '|' || lang, count(*)::DOUBLE FROM (SELECT DISTINCT source, lang, quality FROM documents JOIN labels USING (doc_id)) GROUP BY source, lang HAVING count(*) < 2
 UNION ALL SELECT 'small_class', source || '|' || lang, min(n)::DOUBLE FROM (SELECT source, lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2, 3) GROUP BY source, lang HAVING min(n) < 2
 UNION ALL SELECT 'unique_ratio', 'l_discount', count(DISTINCT l_discount)::DOUBLE / count(*) FROM lineitem HAVING count(DISTINCT l_discount)::DOUBLE / count(*) < 0.1
 UNION ALL SELECT 'not_binary', segment, count(DISTINCT status)::DOUBLE FROM samples GROUP BY segment HAVING count(DISTINCT status) > 2
 UNION ALL SELECT 'duplicate', conv_id::VARCHAR, count(*)::DOUBLE FROM conversations GROUP BY conv_id HAVING count(*) > 1""")
def contract_violations(spark, d):
    orders = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    docs, conv = table(spark, d, "documents"), table(spark, d, "conversations")
    labelled = docs.select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id")
    return all_violations(
        cardinality_violations(orders, ["day", "o_orderpriority", "o_orderstatus"]),
        cardinality_violations(docs, ["source", "lang"]),
        group_class_violations(labelled, ["source", "lang"], "quality"),
        unique_ratio_violations(table(spark, d, "lineitem"), "l_discount"),
        class_count_violations(samples(spark, d), ["segment"], "status"),
        duplicate_violations(conv.select("conv_id"), "conv_id"),
    )


@query("identifiable", with_ctes("piv_logodds_r2") + f"""SELECT dataset, trial, {r('a_total')} AS a_total, {r('a_none')} AS a_none
 FROM piv_logodds_r2 WHERE a_total > a_none + 0.1""")
def identifiable_query(spark, d):
    df = identifiable(set_scores(spark, d).select("dataset", "trial", "a_total", "a_none"))
    return df.withColumns({c: rnd(c) for c in ("a_total", "a_none")})


@query("label_chain", r"""SELECT page_id, regexp_extract(rtrim(url, '/'), '([^/]*)$', 1) AS base,
 replace(replace(url, 'https://', ''), 'http://', '') || '!' AS chained,
 replace(replace(replace(replace(url, '_', '-'), 'attr-', '$L_{'), 'lbl-', '$y_{'), 'cov-', '$C_{') || '}$' AS symbol FROM pages""")
def label_chain(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", basename(url).alias("base"),
        replace_chain(url, [("https://", ""), ("http://", "")], "!").alias("chained"),
        symbol_label(url).alias("symbol"))
