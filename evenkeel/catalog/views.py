"""Views over the test tables that the queries share, in Spark and in SQL."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evenkeel.catalog.registry import h, u
from evenkeel.functions.hashing import hash52, unit_hash
from evenkeel.functions.names import pack_name
from evenkeel.functions.stats import expit
from evenkeel.operators.metrics import score_long
from evenkeel.plans.reports import pivot_sets

SETS = ("test_all", "test_with_con", "test_with_dir", "test_none")
SHRINK = (1.0, 0.7, 0.4, 0.05)
SCORE_METRICS = ("balanced_accuracy", "d2", "logodds_r2", "logodds_mse")


@lru_cache(maxsize=None)
def _schema(path: str) -> StructType:
    """Schemas are inferred once per file, not once per query."""
    return SparkSession.active().read.parquet(path).schema


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    path = f"{d}/{name}.parquet"
    return spark.read.schema(_schema(path)).parquet(path)


def spread_table(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    """Columns of a table."""
    df = table(spark, d, name)
    return df.select(*cols) if cols else df


def samples(spark: SparkSession, d: str) -> DataFrame:
    """One row per order with its customer's segment and region."""
    o = spread_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
                     "o_totalprice")
    c, n = (table(spark, d, t) for t in ("customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"),
        F.col("n_regionkey").cast("bigint").alias("region"),
        F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("bal"),
        (F.col("o_orderstatus") == "F").cast("bigint").alias("y"),
    )


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Samples with a drawn label, a prediction per evaluation set, and a fold."""
    z = (F.col("price") - 250000.0) / 100000.0
    pick = (hash52(F.col("id"), "set", 7) % 4).cast("int")
    shrink = F.element_at(F.array(*[F.lit(s) for s in SHRINK]), pick + 1)
    name = F.element_at(F.array(*[F.lit(s) for s in SETS]), pick + 1)
    return samples(spark, d).select(
        "id", "segment", "priority", "region", "price", "bal",
        z.alias("z"),
        (unit_hash(F.col("id"), "y", 7) < expit(z)).cast("bigint").alias("y"),
        expit(z).alias("p_true"), expit(z * shrink).alias("p"), (z * shrink).alias("logit"),
        name.alias("eval_set"), (hash52(F.col("id"), "fold", 7) % 5).alias("fold"),
    )


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Long scores by (segment as data set, fold as trial, evaluation set)."""
    df = scored(spark, d).withColumnsRenamed({"segment": "dataset", "fold": "trial"})
    return score_long(df, "y", "p", ["dataset", "trial", "eval_set"], SCORE_METRICS)


def set_scores(spark: SparkSession, d: str, metric: str = "logodds_r2") -> DataFrame:
    """One metric with a column per evaluation set."""
    one = scores(spark, d).where(F.col("metric") == metric)
    return pivot_sets(one, ["dataset", "trial"], {
        "test_all": "a_total", "test_with_con": "a_minus_dir",
        "test_with_dir": "a_minus_con", "test_none": "a_none",
    })


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Wide run table with path-like data set names and one unscored cell."""
    ss = set_scores(spark, d, "d2")
    missing = (F.col("trial") == 0) & (F.col("dataset") == "BUILDING")
    return ss.select(
        F.concat(F.lit("out/"), "dataset", F.lit("/train/")).alias("dataset"), "trial",
        F.lit("lbl_y").alias("out"), F.lit("attr_all").alias("inp"), F.lit("LR").alias("model"),
        F.lit("C-1").alias("model_params"), F.lit("baseline").alias("type"),
        F.col("a_total").alias("score_test_d2"),
        F.when(~missing, F.col("a_none")).alias("score_none_d2"),
    )


def rules_v(spark: SparkSession, d: str) -> DataFrame:
    """Rules learned from the samples: how each parent state shifts its children."""
    cell = samples(spark, d).groupBy("segment", "priority").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.sum("price").alias("price"))
    seg = cell.groupBy("segment").agg(
        F.sum("n").alias("t"), F.sum("y").alias("ty"),
        F.array_sort(F.collect_list(F.struct("priority", "n"))).alias("c"))
    attr = seg.select(
        F.lit("segment").alias("parent"), F.col("segment").alias("state"), F.lit("attr").alias("child"),
        F.transform("c", lambda x: F.round(20 * (x["n"] / F.col("t") - 0.2), 4)).alias("w"))

    def label(rows, parent, e):
        return rows.select(F.lit(parent).alias("parent"), F.col(parent).alias("state"),
                           F.lit("lbl_y").alias("child"), F.array(F.lit(0.0), F.round(e, 4)).alias("w"))

    prio = cell.groupBy("priority").agg((F.sum("price") / F.sum("n")).alias("mean"))
    return attr.unionByName(label(seg, "segment", 10 * (F.col("ty") / F.col("t") - F.lit(0.333)))).unionByName(
        label(prio, "priority", 10 * (F.col("mean") / 250000.0 - 1)))


def states_v(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.expr("stack(4, 'segment', segment, 'priority', priority, 'attr', priority,"
                   " 'lbl_y', concat('s', y)) as (var, state)")
    distinct = samples(spark, d).select(pairs).distinct()
    w = Window.partitionBy("var").orderBy("state")  # a handful of states per variable
    return distinct.select("var", (F.row_number().over(w) - 1).cast("bigint").alias("ix"), "state")


def edges_v(spark: SparkSession, d: str) -> DataFrame:
    """A causal graph read off the samples: an edge where a pair is over-represented."""
    s = samples(spark, d)

    def over(a, b, pa, pb):
        n = s.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
        mean = n.agg(F.avg("n")).scalar()
        return n.where(F.col("n") > mean).select(
            F.concat(F.lit(pa), F.col(a)).alias("parent"), F.concat(F.lit(pb), F.col(b)).alias("child"))

    return (over("segment", "priority", "cov_", "attr-")
            .unionByName(over("segment", "status", "cov_", "lbl_"))
            .unionByName(over("priority", "status", "attr-", "lbl_")))


def names_v(spark: SparkSession, d: str) -> DataFrame:
    """Effect triples and packed data set names from the line items' percents."""
    li = table(spark, d, "lineitem")
    cons = F.when(F.col("l_linestatus") == "O", F.array(F.lit("cov_1_cat2"))).otherwise(
        F.array(F.lit("cov_1_cat2"), F.lit("cov_2_cont")))
    base = li.select(
        F.concat(F.lit("lat_"), "l_returnflag", F.lit("_vol")).alias("direct"), cons.alias("cons"),
        (F.round(F.col("l_discount") * 100).cast("bigint") + 1).alias("cX"),
        (F.round(F.col("l_tax") * 100).cast("bigint") + 1).alias("cy"),
        F.col("l_quantity").cast("bigint").alias("Xy"),
        F.when(F.col("l_returnflag") == "A", "v1").otherwise("").alias("suffix"),
    ).distinct()
    cys = F.when(F.size("cons") == 1, F.array("cy")).otherwise(F.array("cy", F.col("cy") + 10))
    return base.withColumn("cys", cys).withColumn(
        "name", pack_name(F.col("direct"), F.col("cons"), F.col("cX"), F.col("cys"), F.col("Xy"),
                          F.col("suffix")))


# --- SQL -------------------------------------------------------------------------------

LL = """(CASE WHEN y = 1 THEN -ln(least(greatest(p, 2.220446049250313e-16::DOUBLE), 1 - 2.220446049250313e-16::DOUBLE))
 ELSE -ln(1 - least(greatest(p, 2.220446049250313e-16::DOUBLE), 1 - 2.220446049250313e-16::DOUBLE)) END)"""
PC = "least(greatest(p, 1e-6::DOUBLE), (1 - 1e-6::DOUBLE))"
LOGIT_P = f"ln({PC} / (1 - {PC}))"
PSEUDO = "(CASE WHEN y = 1 THEN 0.99::DOUBLE ELSE 0.01::DOUBLE END)"
LOGIT_Y = f"ln({PSEUDO} / (1 - {PSEUDO}))"
TPR = "avg(CASE WHEN y = 1 THEN (p > 0.5)::INT::DOUBLE END)"
TNR = "avg(CASE WHEN y = 0 THEN 1 - (p > 0.5)::INT::DOUBLE END)"
BACC = f"(coalesce({TPR}, {TNR}) + coalesce({TNR}, {TPR})) / 2"
D2 = f"1 - avg({LL}) / 0.6931471805599453::DOUBLE"
LO_R2 = f"1 - sum(pow({LOGIT_Y} - {LOGIT_P}, 2)) / nullif(count(y) * var_pop({LOGIT_Y}), 0)"
LO_MSE = f"avg(pow({LOGIT_Y} - {LOGIT_P}, 2))"

_PICK = lambda vals: "CASE " + h("id", "'set'", "7") + " % 4 " + " ".join(
    f"WHEN {i} THEN {v}" for i, v in enumerate(vals)) + " END"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "samples": ((), """SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority,
 c_mktsegment AS segment, n_regionkey::BIGINT AS region, o_totalprice AS price, c_acctbal AS bal,
 (o_orderstatus = 'F')::BIGINT AS y
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""),
    "zs": (("samples",), f"""SELECT *, (price - 250000.0::DOUBLE) / 100000.0::DOUBLE AS z,
 {_PICK([f"'{s}'" for s in SETS])} AS eval_set, {_PICK([f"{s}::DOUBLE" for s in SHRINK])} AS shrink,
 {h("id", "'fold'", "7")} % 5 AS fold FROM samples"""),
    "scored": (("zs",), f"""SELECT id, segment, priority, region, price, bal, z,
 ({u("id", "'y'", "7")} < 1 / (1 + exp(-z)))::BIGINT AS y, 1 / (1 + exp(-z)) AS p_true,
 1 / (1 + exp(-(z * shrink))) AS p, z * shrink AS logit, eval_set, fold FROM zs"""),
    "ev": (("scored",), f"""SELECT segment AS dataset, fold AS trial, eval_set,
 {BACC} AS balanced_accuracy, {D2} AS d2, {LO_R2} AS logodds_r2, {LO_MSE} AS logodds_mse
 FROM scored GROUP BY 1, 2, 3"""),
    "scores": (("ev",), """SELECT dataset, trial, eval_set, metric, value FROM ev
 UNPIVOT (value FOR metric IN (balanced_accuracy, d2, logodds_r2, logodds_mse))"""),
    "runs": (("ev",), """SELECT 'out/' || dataset || '/train/' AS dataset, trial, 'lbl_y' AS out, 'attr_all' AS inp,
 'LR' AS model, 'C-1' AS model_params, 'baseline' AS type,
 avg(CASE WHEN eval_set = 'test_all' THEN d2 END) AS score_test_d2,
 CASE WHEN NOT (trial = 0 AND dataset = 'BUILDING') THEN avg(CASE WHEN eval_set = 'test_none' THEN d2 END) END
 AS score_none_d2 FROM ev GROUP BY ev.dataset, trial"""),
    "cell": (("samples",), "SELECT segment, priority, count(*) AS n FROM samples GROUP BY 1, 2"),
    "rules_v": (("cell",), """
 SELECT 'segment' AS parent, segment AS state, 'attr' AS child,
  list(round(20 * (n::DOUBLE / t - 0.2::DOUBLE), 4) ORDER BY priority) AS w
 FROM cell JOIN (SELECT segment AS sg, sum(n)::DOUBLE AS t FROM cell GROUP BY 1) ON sg = segment GROUP BY segment
 UNION ALL SELECT 'segment', segment, 'lbl_y', [0.0::DOUBLE, round(10 * (avg(y) - 0.333::DOUBLE), 4)] FROM samples GROUP BY segment
 UNION ALL SELECT 'priority', priority, 'lbl_y', [0.0::DOUBLE, round(10 * (avg(price) / 250000.0::DOUBLE - 1), 4)]
 FROM samples GROUP BY priority"""),
    "states_v": (("samples",), """SELECT var, row_number() OVER (PARTITION BY var ORDER BY state) - 1 AS ix, state FROM (
 SELECT DISTINCT 'segment' AS var, segment AS state FROM samples UNION SELECT 'priority', priority FROM samples
 UNION SELECT 'attr', priority FROM samples UNION SELECT 'lbl_y', 's' || y FROM samples)"""),
    "edges_v": (("samples",), """
 SELECT 'cov_' || a AS parent, 'attr-' || b AS child FROM (SELECT segment AS a, priority AS b, count(*) AS n, avg(count(*)) OVER () AS m FROM samples GROUP BY 1, 2) WHERE n > m
 UNION ALL SELECT 'cov_' || a, 'lbl_' || b FROM (SELECT segment AS a, status AS b, count(*) AS n, avg(count(*)) OVER () AS m FROM samples GROUP BY 1, 2) WHERE n > m
 UNION ALL SELECT 'attr-' || a, 'lbl_' || b FROM (SELECT priority AS a, status AS b, count(*) AS n, avg(count(*)) OVER () AS m FROM samples GROUP BY 1, 2) WHERE n > m"""),
    "names_v": ((), """SELECT *, 'con' || n || '_lat-' || flag || '-vol_cov-1-cat2' || CASE WHEN n = 2 THEN '_cov-2-cont' ELSE '' END
  || '_cX' || lpad(cX::VARCHAR, 3, '0') || '_c1y' || lpad(cy::VARCHAR, 3, '0')
  || CASE WHEN n = 2 THEN '_c2y' || lpad((cy + 10)::VARCHAR, 3, '0') ELSE '' END
  || '_Xy' || lpad(Xy::VARCHAR, 3, '0') || CASE WHEN suffix = '' THEN '' ELSE '_' || suffix END AS name FROM (
 SELECT DISTINCT l_returnflag AS flag, 'lat_' || l_returnflag || '_vol' AS direct, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS n,
  round(l_discount * 100)::BIGINT + 1 AS cX, round(l_tax * 100)::BIGINT + 1 AS cy, l_quantity::BIGINT AS Xy,
  CASE WHEN l_returnflag = 'A' THEN 'v1' ELSE '' END AS suffix FROM lineitem)"""),
}


def piv_cte(metric: str) -> str:
    cols = ", ".join(
        f"avg(CASE WHEN eval_set = '{s}' THEN {metric} END) AS {n}"
        for s, n in (("test_all", "a_total"), ("test_with_con", "a_minus_dir"),
                     ("test_with_dir", "a_minus_con"), ("test_none", "a_none")))
    return f"SELECT dataset, trial, {cols} FROM ev GROUP BY 1, 2"


for _m in SCORE_METRICS:
    CTES[f"piv_{_m}"] = (("ev",), piv_cte(_m))


def with_ctes(*names: str, **extra: str) -> str:
    """WITH clause holding the named views, their dependencies, then ``extra``."""
    ordered: list[str] = []

    def add(n: str) -> None:
        for dep in CTES[n][0]:
            add(dep)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({CTES[n][1]})" for n in ordered]
    parts += [f"{n} AS ({body})" for n, body in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n"


