"""Streaming queries: the tables arrive as files, the result equals the batch one."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.catalog.registry import query, r, rnd, u
from evenkeel.catalog.rules import draw_sql, probas_sql
from evenkeel.catalog.views import D2, LO_MSE, table
from evenkeel.functions.stats import expit
from evenkeel.streaming.scores import (
    drain_groups,
    drain_rows,
    read_stream,
    stream_assign,
    stream_scores,
)

EV = """WITH e AS (SELECT event_id, user_id % 10 AS grp, (event_type IN ('purchase', 'click'))::INT AS y, 1 / (1 + exp(-(value - 50.0::DOUBLE) / 50.0::DOUBLE)) AS p FROM events)
"""


@query("stream_d2", EV + f"SELECT grp, {r(D2)} AS d2, {r(LO_MSE)} AS logodds_mse, {r('avg((y = (p > 0.5)::INT)::INT::DOUBLE)')} AS accuracy FROM e GROUP BY 1")
def stream_d2(spark, d):
    ev = read_stream(spark, f"{d}/events.parquet")
    rows = ev.select((F.col("user_id") % 10).alias("grp"), F.col("event_type").isin("purchase", "click").cast("int").alias("y"),
                     expit((F.col("value") - 50.0) / 50.0).alias("p"))
    out = drain_groups(stream_scores(rows, "y", "p", ["grp"], ["d2", "logodds_mse", "accuracy"]), "running_scores")
    return out.withColumns({c: rnd(c) for c in ("d2", "logodds_mse", "accuracy")})


@query("stream_assign", f"""WITH rl AS (SELECT event_type AS state, [round(avg(value) / 50 - 1, 4), 0.0::DOUBLE, round(count(*)::DOUBLE / 10000, 4)] AS w FROM events GROUP BY 1),
 p AS (SELECT event_id, {probas_sql('w')} AS p FROM events JOIN rl ON state = event_type)
 SELECT event_id, {draw_sql('p', u('event_id', "'tier'", "3"))} AS tier FROM p""")
def stream_assign_query(spark, d):
    path = f"{d}/events.parquet"
    w = F.array(F.round(F.avg("value") / 50 - 1, 4), F.lit(0.0), F.round(F.count(F.lit(1)).cast("double") / 10000, 4))
    rules = table(spark, d, "events").groupBy("event_type").agg(w.alias("w")).select(
        F.lit("event_type").alias("parent"), F.col("event_type").alias("state"), F.lit("tier").alias("child"), "w")
    ev = read_stream(spark, path).select("event_id", "event_type")
    out = stream_assign(ev, rules, "tier", ["event_type"], 3, "event_id", 3)
    return drain_rows(out.select("event_id", "tier"), "tiers")
