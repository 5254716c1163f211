"""Gapless positions of rows within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.operators.sizing import broadcast_if_small
from evenkeel.session import cut_lineage


def positions(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "pos") -> DataFrame:
    """Add each row's place (bigint, from 0) within its ``group`` by ascending ``order``, nulls first.

    Rows are dealt by ranges of (group, order), so that a group with a third of all rows covers
    a third of the tasks, and numbered within (group, range). Only a group that goes on from an
    earlier range needs an offset: at most one row per range."""
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    dealt = cut_lineage(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranges")
    number = F.row_number().over(Window.partitionBy(*group, "__range").orderBy(*keys[len(group):]))
    runs = dealt.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.sum("__n").over(earlier)).where("__before is not null")
    carried = runs.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.col("__range").alias("__r"), "__before")
    same = [F.col("__range") == F.col("__r"), *[F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)]]
    placed = dealt.withColumn("__k", number - 1).join(broadcast_if_small(carried), same, "left")
    at = (F.col("__k") + F.coalesce("__before", F.lit(0))).cast("bigint")
    return placed.select(*df.columns, at.alias(out))
