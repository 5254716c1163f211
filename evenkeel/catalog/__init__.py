"""Every library operator applied to the test tables, paired with a SQL twin."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("sources", "frames", "rules", "splits", "features", "models", "metrics", "reports", "streams")


def load():
    """(queries, sql) of all catalog modules."""
    for m in MODULES:
        import_module(f"evenkeel.catalog.{m}")
    from evenkeel.catalog.registry import QUERIES, SQL

    return QUERIES, SQL


def flagship(spark: SparkSession, d: str) -> DataFrame:
    from evenkeel.catalog.metrics import balanced_region_scores

    return balanced_region_scores(spark, d)
