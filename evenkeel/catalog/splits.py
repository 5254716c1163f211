"""Queries over splits, samples, counterbalancing and residualisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.catalog.registry import h, query, r, rnd, u
from evenkeel.catalog.views import samples, scored, spread_table, table, with_ctes
from evenkeel.operators.balance import (
    control_confounds,
    counterbalance_mixed,
    counterbalance_up,
    group_code,
)
from evenkeel.operators.residual import residualize_categorical, residualize_continuous
from evenkeel.operators.splits import (
    capped_sample,
    check_assigned,
    fold_parts,
    group_sample,
    repeated_shuffle_split,
    representative_row,
    split_long,
    stratified_holdout,
    stratified_kfold,
    thin_values,
)

SEED = "42"


def order_by_hash(id_: str = "id", seed: str = SEED) -> str:
    return f"{h(id_, repr(seed))}, {id_}"


def labelled_docs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id")


@query("stratified_holdout", f"""SELECT o_orderkey AS id, o_orderstatus AS lbl, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY {order_by_hash('o_orderkey')})
 <= round(0.2::DOUBLE * count(*) OVER (PARTITION BY o_orderstatus)) THEN 'test' ELSE 'train' END AS part FROM orders""")
def stratified_holdout_query(spark, d):
    df = spread_table(spark, d, "orders", "o_orderkey", "o_orderstatus").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("lbl"))
    return stratified_holdout(df, "lbl", "id", 0.2, SEED)


@query("stratified_kfold", f"""SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY {order_by_hash('doc_id')}) - 1) % 5 AS fold FROM labels""")
def stratified_kfold_query(spark, d):
    return stratified_kfold(table(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id", 5, SEED)


@query("fold_parts", f"""WITH f AS (SELECT o_orderstatus AS lbl, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY {order_by_hash('o_orderkey')}) - 1) % 5 AS fold FROM orders)
 SELECT lbl, trial, CASE WHEN trial = fold THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM (SELECT *, unnest(range(0, 5)) AS trial FROM f) GROUP BY 1, 2, 3""")
def fold_parts_query(spark, d):
    df = spread_table(spark, d, "orders", "o_orderkey", "o_orderstatus").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("lbl"))
    long = fold_parts(stratified_kfold(df, "lbl", "id", 5, SEED), 5)
    return long.groupBy("lbl", "trial", "part").agg(F.count(F.lit(1)).alias("n"))


def _trial(i: int) -> str:
    return (f"CASE WHEN row_number() OVER (PARTITION BY y ORDER BY {order_by_hash('id', f'{SEED}:{i}')})"
            f" <= round(0.1::DOUBLE * count(*) OVER (PARTITION BY y)) THEN 'val' ELSE 'train' END AS trial_{i}")


@query("shuffle_split_wide", f"WITH s AS (SELECT o_orderkey AS id, o_orderstatus AS y FROM orders) SELECT id, y, {', '.join(map(_trial, range(5)))} FROM s")
def shuffle_split_wide(spark, d):
    df = spread_table(spark, d, "orders", "o_orderkey", "o_orderstatus").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("y"))
    wide = repeated_shuffle_split(df, "y", "id", 5, 0.1, SEED)
    return check_assigned(wide, [f"trial_{i}" for i in range(5)])


@query("split_long", f"WITH s AS (SELECT doc_id AS id, quality AS y FROM labels), w AS (SELECT id, {', '.join(map(_trial, range(5)))} FROM s)"
       " SELECT id, replace(trial, 'trial_', '')::BIGINT AS trial, part FROM (UNPIVOT w ON trial_0, trial_1, trial_2, trial_3, trial_4 INTO NAME trial VALUE part)")
def split_long_query(spark, d):
    df = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    long = split_long(repeated_shuffle_split(df, "y", "id", 5, 0.1, SEED), "id", 5)
    return long.withColumn("trial", F.col("trial").cast("bigint"))


@query("group_code", with_ctes("samples") + """, a AS (SELECT segment, row_number() OVER (ORDER BY segment) - 1 AS c FROM (SELECT DISTINCT segment FROM samples)),
 b AS (SELECT priority, row_number() OVER (ORDER BY priority) - 1 AS c FROM (SELECT DISTINCT priority FROM samples))
 SELECT id, a.c + 10 * b.c AS "group" FROM samples JOIN a USING (segment) JOIN b USING (priority)""")
def group_code_query(spark, d):
    return group_code(samples(spark, d).select("id", "segment", "priority"), ["segment", "priority"]).select("id", "group")


@query("counterbalance_down", with_ctes("samples") + f""", c AS (SELECT *, count(*) OVER (PARTITION BY segment, y) AS n,
  row_number() OVER (PARTITION BY segment, y ORDER BY {order_by_hash()}) AS rn FROM samples),
 m AS (SELECT *, min(n) OVER (PARTITION BY segment) AS k FROM c)
 SELECT id, segment, y FROM m WHERE rn <= k""")
def counterbalance_down_query(spark, d):
    kept, ok = control_confounds(samples(spark, d).select("id", "segment", "y"), "downsample", "y", "id", ["segment"], seed=SEED)
    assert ok
    return kept


UP = f""", c AS (SELECT id, segment, y, count(*) OVER (PARTITION BY segment, y) AS n,
  row_number() OVER (PARTITION BY segment, y ORDER BY {order_by_hash()}) AS rn FROM src),
 m AS (SELECT *, max(n) OVER (PARTITION BY segment) AS k FROM c),
 need AS (SELECT DISTINCT segment, y, n, k - n AS m FROM m WHERE k > n),
 draws AS (SELECT segment, y, 1 + floor({u("segment || '|' || y", 'i', repr(SEED))} * n)::BIGINT AS rn FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM need)),
 up AS (SELECT id, segment, y FROM src UNION ALL SELECT id, segment, y FROM draws JOIN m USING (segment, y, rn))"""


@query("counterbalance_up", with_ctes("samples").rstrip() + ", src AS (SELECT * FROM samples)" + UP + "SELECT id, segment, y FROM up")
def counterbalance_up_query(spark, d):
    return counterbalance_up(samples(spark, d).select("id", "segment", "y"), "y", "id", ["segment"], SEED)


@query("counterbalance_mixed", with_ctes("samples").rstrip() + f""", src AS (SELECT * FROM samples WHERE {h('segment', repr(SEED))} % 2 = 1)""" + UP + f""",
 dn AS (SELECT *, count(*) OVER (PARTITION BY segment, y) AS n, row_number() OVER (PARTITION BY segment, y ORDER BY {order_by_hash()}) AS rn
  FROM samples WHERE {h('segment', repr(SEED))} % 2 = 0),
 dm AS (SELECT *, min(n) OVER (PARTITION BY segment) AS k FROM dn)
 SELECT id, segment, y FROM up UNION ALL SELECT id, segment, y FROM dm WHERE rn <= k""")
def counterbalance_mixed_query(spark, d):
    return counterbalance_mixed(samples(spark, d).select("id", "segment", "y"), "y", "id", ["segment"], SEED)


@query("counterbalance_rejects", """WITH l AS (SELECT doc_id, lang, source, quality FROM documents JOIN labels USING (doc_id)) SELECT doc_id, lang, source, quality FROM l""")
def counterbalance_rejects(spark, d):
    """Groups with one class: the control is refused and the data stays as it is."""
    df = labelled_docs(spark, d).withColumn("grp", F.when(F.col("quality") == 1, "only-good").otherwise(F.col("lang")))
    kept, ok = control_confounds(df, "downsample", "quality", "doc_id", ["grp"], seed=SEED)
    assert not ok
    return kept.select("doc_id", "lang", "source", "quality")


@query("capped_sample", f"SELECT event_id, event_type FROM events ORDER BY {order_by_hash('event_id')} LIMIT 1000")
def capped_sample_query(spark, d):
    return capped_sample(table(spark, d, "events").select("event_id", "event_type"), "event_id", 1000, SEED)


@query("group_sample", with_ctes("samples") + f"""SELECT id, segment, status FROM samples QUALIFY row_number() OVER (PARTITION BY segment, status ORDER BY {order_by_hash()}) <= 15""")
def group_sample_query(spark, d):
    return group_sample(samples(spark, d).select("id", "segment", "status"), ["segment", "status"], "id", 15, SEED)


@query("representative_row", """SELECT p_brand, p_size::BIGINT AS p_size, p_type, p_partkey FROM part
 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_type, p_partkey) = 1""")
def representative_row_query(spark, d):
    part = table(spark, d, "part").select("p_brand", F.col("p_size").cast("bigint").alias("p_size"), "p_type", "p_partkey")
    return representative_row(part, "p_brand", ["p_size", "p_type", "p_partkey"])


@query("thin_values", f"""WITH v AS (SELECT DISTINCT p_size::BIGINT AS p_size FROM part), e AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM v)
 SELECT p_size FROM v, e ORDER BY (p_size = lo OR p_size = hi) DESC, {h('p_size', repr(SEED))}, p_size LIMIT 7""")
def thin_values_query(spark, d):
    return thin_values(table(spark, d, "part").select(F.col("p_size").cast("bigint").alias("p_size")), "p_size", 7, SEED)


@query("residualize_cat", with_ctes("samples") + f"""SELECT id, {r('price - (avg(price) OVER (PARTITION BY segment) - avg(price) OVER ())', 4)} AS price_res,
 {r('bal - (avg(bal) OVER (PARTITION BY segment) - avg(bal) OVER ())', 4)} AS bal_res FROM samples""")
def residualize_cat(spark, d):
    out = residualize_categorical(samples(spark, d), ["price", "bal"], "segment")
    return out.select("id", rnd("price_res", 4).alias("price_res"), rnd("bal_res", 4).alias("bal_res"))


@query("residualize_cont", with_ctes("scored") + f""", s AS (SELECT regr_slope(p, price) AS sp, regr_slope(bal, price) AS sb FROM scored)
 SELECT id, {r('p - sp * price')} AS p_res, {r('bal - sb * price', 4)} AS bal_res FROM scored, s""")
def residualize_cont(spark, d):
    out = residualize_continuous(scored(spark, d), ["p", "bal"], "price")
    return out.select("id", rnd("p_res").alias("p_res"), rnd("bal_res", 4).alias("bal_res"))
