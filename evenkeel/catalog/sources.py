"""Queries over the readers, writers and table-shaping helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.catalog.registry import query, r, rnd
from evenkeel.catalog.views import table, with_ctes
from evenkeel.functions.text import format_id, parse_list
from evenkeel.session import scratch_path
from evenkeel.sources.results import METADATA_FILE, METRICS_FILE, read_checkpoint_logs, read_effect_tables, union_runs
from evenkeel.sources.samples import (
    attach_features,
    explode_features,
    read_holdouts,
    read_samples,
    tag_holdouts,
    write_if_absent,
    write_samples,
)
from evenkeel.operators.contracts import require_rows


@query("scan_samples", """SELECT o_orderkey AS id, o_orderstatus AS lbl_y, o_orderpriority AS cov_priority,
 o_totalprice AS price FROM orders""")
def scan_samples(spark, d):
    df = require_rows(read_samples(spark, f"{d}/orders.parquet"))
    return df.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("lbl_y"),
                     F.col("o_orderpriority").alias("cov_priority"), F.col("o_totalprice").alias("price"))


@query("scan_holdouts", f"""SELECT CASE o_orderstatus WHEN 'F' THEN 'test_all' WHEN 'O' THEN 'test_none' ELSE 'test_with_p' END
 AS eval_set, count(*) AS n, {r('avg(o_totalprice)', 4)} AS price FROM orders GROUP BY 1""")
def scan_holdouts(spark, d):
    whole = read_samples(spark, f"{d}/orders.parquet")
    part = lambda s: whole.where(F.col("o_orderstatus") == s)
    sets = tag_holdouts({"test_all": part("F"), "test_none": part("O"), "test_with_p": part("P")})
    return sets.groupBy("eval_set").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg("o_totalprice"), 4).alias("price"))


@query("read_holdouts", """SELECT 'customers' AS eval_set, c_nationkey::BIGINT AS nation, count(*) AS n FROM customer GROUP BY 2
 UNION ALL SELECT 'suppliers', s_nationkey::BIGINT, count(*) FROM supplier GROUP BY 2""")
def read_holdout_files(spark, d):
    both = read_holdouts(spark, {"customers": f"{d}/customer.parquet", "suppliers": f"{d}/supplier.parquet"})
    nation = F.coalesce("c_nationkey", "s_nationkey").cast("bigint")
    return both.groupBy("eval_set", nation.alias("nation")).agg(F.count(F.lit(1)).alias("n"))


@query("write_read_roundtrip", f"""SELECT l_returnflag AS split, l_linestatus AS lbl, count(*) AS n,
 {r('sum(l_extendedprice)', 2)} AS total FROM lineitem GROUP BY 1, 2""")
def write_read_roundtrip(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    out = scratch_path(spark, "samples")
    for split in ("A", "N", "R"):
        write_samples(li.where(F.col("l_returnflag") == split), out, split)
    write_samples(li.where(F.col("l_returnflag") == "N"), out, "N")  # replaces one split only
    whole = spark.read.parquet(out)
    return whole.groupBy("split", F.col("l_linestatus").alias("lbl")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("l_extendedprice"), 2).alias("total"))


@query("write_if_absent", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def write_if_absent_query(spark, d):
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    out = scratch_path(spark, "runs")
    write_if_absent(counts, out)
    return write_if_absent(counts.withColumn("n", F.lit(0).cast("bigint")), out)


@query("union_runs", with_ctes("runs") + f"""
 SELECT dataset, trial, out, inp, model, model_params, type, {r('score_test_d2')} AS score_test_d2, NULL::DOUBLE AS score_none_d2,
 'a' AS source FROM runs
 UNION ALL SELECT dataset, trial, out, inp, 'RF', model_params, type, {r('score_test_d2')}, {r('score_none_d2')}, 'b' FROM runs""")
def union_runs_query(spark, d):
    from evenkeel.catalog.views import runs

    df = runs(spark, d)
    df = df.withColumns({c: rnd(c) for c in ("score_test_d2", "score_none_d2")})
    a = df.drop("score_none_d2").withColumn("source", F.lit("a"))
    b = df.withColumn("model", F.lit("RF")).withColumn("source", F.lit("b"))
    return union_runs([a, b])


@query("json_parse", """SELECT event_id, (props->>'$.k')::BIGINT AS k, (('[' || value || ', ' || event_id || ']')::DOUBLE[])[1] AS first,
 len(('[' || value || ', ' || event_id || ']')::DOUBLE[])::BIGINT AS n FROM events""")
def json_parse(spark, d):
    text = F.concat(F.lit("["), F.col("value").cast("string"), F.lit(", "), F.col("event_id").cast("string"), F.lit("]"))
    ev = table(spark, d, "events").withColumn("arr", parse_list(text))
    k = F.from_json("props", "k bigint")["k"]
    return ev.select("event_id", k.alias("k"), F.col("arr")[0].alias("first"), F.size("arr").cast("bigint").alias("n"))


@query("feature_array_join", f"""SELECT item_id, {', '.join(f"{r(f'embedding[{i + 1}]')} AS p_{i}" for i in range(64))}
 FROM (SELECT doc_id AS item_id FROM documents) LEFT JOIN embeddings ON item_id = vec_id""")
def feature_array_join(spark, d):
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"))
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    wide = attach_features(ids, vec, "item_id", "embedding", 64)
    return wide.select("item_id", *[rnd(F.col(c).cast("double")).alias(c) for c in wide.columns[1:]])


@query("feature_positions", f"""SELECT (pos - 1)::BIGINT AS pos, count(*) AS n, {r('avg(v)', 5)} AS mean FROM
 (SELECT unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY 1""")
def feature_positions(spark, d):
    long = explode_features(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding")
    return long.groupBy(F.col("pos").cast("bigint").alias("pos")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg(F.col("value").cast("double")), 5).alias("mean"))


@query("format_id", """SELECT p_partkey AS id, CASE WHEN length(p_partkey::VARCHAR) < 5 THEN lpad(p_partkey::VARCHAR, 5, '0')
 ELSE p_partkey::VARCHAR END AS name FROM part""")
def format_id_query(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), format_id(F.col("p_partkey")).alias("name"))




def _named_files(spark, df, out: str, writer: str, rename, **options) -> str:
    """Write ``df`` (folder columns a, b, ..) with one file per (a, b) and give each file the path
    below ``out`` that ``rename`` finds for (a, b). There are a few folders only."""
    made = scratch_path(spark, "parts")
    getattr(df.repartition("a", "b").write.partitionBy("a", "b").options(**options), writer)(made)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(made).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(path(f"{made}/a=*/b=*/part-*")):
        file = status.getPath()
        b, a = file.getParent().getName()[2:], file.getParent().getParent().getName()[2:]
        target = path(f"{out}/{rename(a, b)}")
        fs.mkdirs(target.getParent())
        fs.rename(file, target)
    return out


@query("read_checkpoint_logs", f"""SELECT l_returnflag || l_linenumber AS checkpoint, count(*) AS n, sum(l_orderkey)::BIGINT AS ids,
 {r('avg(l_quantity)', 4)} AS loss, {r('max(l_tax)', 4)} AS top FROM lineitem GROUP BY 1""")
def read_checkpoint_logs_query(spark, d):
    """Metadata and metrics of each (return flag, line number) as the files of a checkpoint folder."""
    li = table(spark, d, "lineitem").withColumns({"a": F.col("l_returnflag"), "b": F.col("l_linenumber").cast("string")})
    root = scratch_path(spark, "checkpoints")
    _named_files(spark, li.select("a", "b", "l_orderkey"), root, "csv", lambda a, b: f"{a}/{b}/{METADATA_FILE}", sep="\t", header=True)
    named = F.create_map(F.lit("loss"), F.avg("l_quantity"), F.lit("top"), F.max("l_tax"))
    metrics = li.groupBy("a", "b").agg(F.to_json(F.struct(named.alias("metrics"))).alias("value"))
    _named_files(spark, metrics, root, "text", lambda a, b: f"{a}/{b}/{METRICS_FILE}")
    logs = read_checkpoint_logs(spark, root, "l_orderkey bigint")
    name = F.concat_ws("", F.slice(F.split("checkpoint", "/"), -2, 2))
    return logs.groupBy(name.alias("checkpoint")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("ids"),
        rnd(F.max(F.col("metrics")["loss"]), 4).alias("loss"), rnd(F.max(F.col("metrics")["top"]), 4).alias("top"))


@query("read_effect_tables", f"""SELECT 'con1_lat-' || l_returnflag || '-vol_cov-1-cat2_cX' || lpad(l_linenumber::VARCHAR, 3, '0') || '_c1y004_Xy050' AS name, 'cov_1_cat2' AS con_name,
 l_linenumber::DOUBLE AS "cX", 4.0::DOUBLE AS cy, 50.0::DOUBLE AS "Xy", count(*) AS n, {r('avg(l_discount)', 4)} AS proba FROM lineitem GROUP BY l_returnflag, l_linenumber""")
def read_effect_tables_query(spark, d):
    """A file of probabilities for each (return flag, line number), whose name tells the effects."""
    li = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("a"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0").alias("b"),
        F.format_string("[%s, %s]", (1 - F.col("l_discount")).cast("string"), F.col("l_discount").cast("string")).alias("probas_lbl_y"))
    # letters keep the numbers of folder names as text
    li = li.withColumn("b", F.concat(F.lit("x"), "b"))
    root = scratch_path(spark, "effects")
    _named_files(spark, li, root, "csv", lambda a, b: f"con1_lat-{a}-vol_cov-1-cat2_cX{b[1:]}_c1y004_Xy050.csv", header=True)
    rows = read_effect_tables(spark, f"{root}/*.csv", "probas_lbl_y string")
    return rows.groupBy("name", "con_name", "cX", "cy", "Xy").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("proba"), 4).alias("proba"))
