"""Queries over feature encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.catalog.registry import query, r, rnd
from evenkeel.catalog.views import table
from evenkeel.functions.stats import expit, log_odds
from evenkeel.functions.text import tag_name, tag_ordinal
from evenkeel.operators.features import (
    cut_equal_width,
    dense_codes,
    fit_one_hot,
    fit_scaler,
    infer_task,
    label_index,
    ordinal_encode,
    polynomial,
    route_columns,
    scaled_tag,
    sparse_one_hot,
    value_dictionary,
    varying_columns,
    varying_elements,
)


@query("label_index", """SELECT l_orderkey, l_linenumber::BIGINT AS line, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END::BIGINT AS code FROM lineitem""")
def label_index_query(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), "l_returnflag")
    return label_index(li, "l_returnflag", "code").drop("l_returnflag")


@query("one_hot", """SELECT c_custkey, (c_mktsegment = 'AUTOMOBILE')::INT::DOUBLE AS "c_mktsegment_AUTOMOBILE", (c_mktsegment = 'BUILDING')::INT::DOUBLE AS "c_mktsegment_BUILDING",
 (c_mktsegment = 'FURNITURE')::INT::DOUBLE AS "c_mktsegment_FURNITURE", (c_mktsegment = 'HOUSEHOLD')::INT::DOUBLE AS "c_mktsegment_HOUSEHOLD",
 (c_mktsegment = 'MACHINERY')::INT::DOUBLE AS "c_mktsegment_MACHINERY" FROM customer""")
def one_hot(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return fit_one_hot(c, ["c_mktsegment"]).transform(c).drop("c_mktsegment")


@query("sparse_one_hot", """WITH long AS (SELECT c_custkey, unnest([0, 1]) AS i, unnest([c_name, c_mktsegment]) AS value FROM customer),
 codes AS (SELECT i, value, row_number() OVER (ORDER BY i, value) - 1 AS pos FROM (SELECT DISTINCT i, value FROM long))
 SELECT c_custkey, min(pos)::BIGINT AS name_at, max(pos)::BIGINT AS segment_at, count(*)::BIGINT AS n FROM long JOIN codes USING (i, value) GROUP BY 1""")
def sparse_one_hot_query(spark, d):
    """As many indicators as there are customers, and those of the segments."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    cols = ["c_name", "c_mktsegment"]
    out = sparse_one_hot(c, "c_custkey", cols, value_dictionary(c, cols))
    return out.select("c_custkey", F.array_min("indices").alias("name_at"), F.array_max("indices").alias("segment_at"), F.size("indices").cast("bigint").alias("n"))


@query("route_columns", """SELECT unnest(['o_orderstatus', 'o_orderpriority', 'o_totalprice', 'o_custkey']) AS "column", unnest([false, false, true, true]) AS numeric,
 (SELECT count(o_orderkey) FROM orders) AS n""")
def route_columns_query(spark, d):
    o = table(spark, d, "orders")
    cats, nums = route_columns(o, ["o_orderstatus", "o_totalprice", "o_orderpriority", "o_custkey"])
    cells = [F.struct(F.lit(c).alias("column"), F.lit(c in nums).alias("numeric"), F.count(F.col(c)).alias("n")) for c in [*cats, *nums]]
    return o.agg(F.array(*cells).alias("x")).select(F.inline("x"))


@query("one_hot_unseen", """WITH seen AS (SELECT DISTINCT priority AS v FROM (SELECT o_orderpriority AS priority FROM orders WHERE o_orderpriority < '4'))
 SELECT o_orderkey AS id, (SELECT count(*) FROM seen WHERE v = o_orderpriority)::DOUBLE AS hits FROM orders""")
def one_hot_unseen(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    enc = fit_one_hot(o.where(F.col("priority") < "4"), ["priority"])
    hits = sum((F.col(f"`{c}`") for c in enc.names()), F.lit(0.0))
    return enc.transform(o).select("id", hits.alias("hits"))


@query("standardize", f"""SELECT event_id, {r('(value - avg(value) OVER ()) / stddev_pop(value) OVER ()')} AS value,
 {r('(user_id - avg(user_id) OVER ()) / stddev_pop(user_id) OVER ()')} AS user_id FROM events""")
def standardize(spark, d):
    ev = table(spark, d, "events").select("event_id", "value", F.col("user_id").cast("double").alias("user_id"))
    out = fit_scaler(ev, ["value", "user_id"]).transform(ev)
    return out.withColumns({c: rnd(c) for c in ("value", "user_id")})


@query("variance_threshold", """WITH e AS (SELECT unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM embeddings)
 SELECT i AS element FROM e GROUP BY i HAVING var_pop(v) > 0.0155""")
def variance_threshold(spark, d):
    return varying_elements(table(spark, d, "embeddings"), "embedding", 0.0155)


@query("constant_columns", """SELECT c_custkey, c_acctbal FROM customer""")
def constant_columns(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal").withColumn("one", F.lit(1.0))
    return df.select(*varying_columns(df, df.columns))


@query("polynomial_features", f"""SELECT c_custkey, {r('a')} AS a, {r('b')} AS b, {r('a * a')} AS "a^2", {r('a * b')} AS "a b", {r('b * b')} AS "b^2"
 FROM (SELECT c_custkey, c_acctbal / 1000 AS a, c_nationkey::DOUBLE AS b FROM customer)""")
def polynomial_features(spark, d):
    df = table(spark, d, "customer").select(
        "c_custkey", (F.col("c_acctbal") / 1000).alias("a"), F.col("c_nationkey").cast("double").alias("b"))
    out, names = polynomial(df, ["a", "b"], 2)
    return out.select("c_custkey", *[rnd(f"`{n}`").alias(n) for n in names])


@query("infer_task", """SELECT 'l_quantity' AS label, count(DISTINCT l_quantity) AS n_distinct, true AS numeric, 'regression' AS task FROM lineitem
 UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag), false, 'classification' FROM lineitem
 UNION ALL SELECT 'quality', count(DISTINCT quality), true, 'classification' FROM labels""")
def infer_task_query(spark, d):
    li = table(spark, d, "lineitem")
    return (infer_task(li, "l_quantity").unionByName(infer_task(li, "l_returnflag"))
            .unionByName(infer_task(table(spark, d, "labels"), "quality")))


@query("tag_parts", f"""SELECT o_orderkey AS id, split_part(o_orderpriority, '-', 1)::BIGINT AS ordinal, substr(o_orderpriority, 3) AS name,
 {r("split_part(o_orderpriority, '-', 1)::DOUBLE / max(split_part(o_orderpriority, '-', 1)::DOUBLE) OVER ()")} AS scaled FROM orders""")
def tag_parts(spark, d):
    p = F.col("o_orderpriority")
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), tag_ordinal(p).cast("bigint").alias("ordinal"), tag_name(p).alias("name"))
    return scaled_tag(o, "ordinal", "scaled").withColumn("scaled", rnd("scaled"))


@query("ordinal_encode", """SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) - 1 AS code, dense_rank() OVER (ORDER BY p_name) - 1 AS name_code FROM part""")
def ordinal_encode_query(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_name")
    out = ordinal_encode(ordinal_encode(part, "p_type", "code"), "p_name", "name_code")
    return out.select("p_partkey", "code", "name_code")


@query("ordinal_encode_large", """SELECT o_orderkey AS id, dense_rank() OVER (ORDER BY o_totalprice) - 1 AS code FROM orders""")
def ordinal_encode_large(spark, d):
    """More values than fit literals: numbered by range buckets."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    codes = dense_codes(o, "o_totalprice", "code")
    return o.join(codes, "o_totalprice").select("id", "code")


@query("cut_equal_width", """WITH s AS (SELECT *, min(value) OVER () AS lo, max(value) OVER () AS hi FROM events)
 SELECT event_id, least(greatest(ceil((value - lo) / ((hi - lo) / 3.0::DOUBLE)), 1), 3)::BIGINT AS bin FROM s""")
def cut_equal_width_query(spark, d):
    ev = table(spark, d, "events").select("event_id", "value")
    return cut_equal_width(ev, "value", "bin").select("event_id", "bin")


@query("log_odds", f"""WITH s AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, l_quantity AS q, l_discount AS dsc FROM lineitem),
 c AS (SELECT *, least(greatest(CASE WHEN max(q) OVER () > 1 THEN q / 100 ELSE q END, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS pq,
  least(greatest(CASE WHEN max(dsc) OVER () > 1 THEN dsc / 100 ELSE dsc END, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS pd FROM s)
 SELECT l_orderkey, line, {r('ln(pq / (1 - pq))')} AS lo_q, {r('ln(pd / (1 - pd))')} AS lo_d, {r('1 / (1 + exp(-ln(pq / (1 - pq))))')} AS back FROM c""")
def log_odds_query(spark, d):
    li = table(spark, d, "lineitem")
    top = li.agg(F.struct(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"))).scalar()
    lo_q = log_odds(F.col("l_quantity"), top["q"])
    return li.select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), rnd(lo_q).alias("lo_q"),
        rnd(log_odds(F.col("l_discount"), top["d"])).alias("lo_d"), rnd(expit(lo_q)).alias("back"))


