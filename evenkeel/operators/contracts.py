"""Guards: each check is a DataFrame of violations, and an error form on top."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CONFOUND_CATEGORIES = 10
MIN_ROWS_PER_CLASS = 2
MIN_UNIQUE_RATIO = 0.1
PROBA_SUM_TOLERANCE = 0.1


class ContractError(ValueError):
    """Input data breaks a documented requirement."""


def require_no_rows(violations: DataFrame, message: str) -> None:
    sample = violations.limit(3).collect()
    if sample:
        raise ContractError(f"{message}: {[r.asDict() for r in sample]}")


def require_rows(df: DataFrame, message: str = "empty table") -> DataFrame:
    if not df.take(1):
        raise ContractError(message)
    return df


def require_columns(df: DataFrame, cols: Sequence[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ContractError(f"columns not in the table: {missing}")


def _violation(check: str, subject: Column, value: Column) -> list[Column]:
    return [
        F.lit(check).alias("check"),
        subject.cast("string").alias("subject"),
        value.cast("double").alias("value"),
    ]


def cardinality_violations(df: DataFrame, confounds: Sequence[str]) -> DataFrame:
    """Confounds with fewer than 2 or more than 10 categories."""
    combos = df.select(*confounds).distinct()  # collapses rows before the distinct counts
    counts = combos.agg(*[F.count_distinct(c).alias(c) for c in confounds])
    long = counts.unpivot([], list(confounds), "subject", "value")
    bad = (F.col("value") < 2) | (F.col("value") > MAX_CONFOUND_CATEGORIES)
    return long.where(bad).select(
        *_violation("confound_cardinality", F.col("subject"), F.col("value"))
    )


def key_text(keys: Sequence[str]) -> Column:
    """Grouping keys as one text. A null is told apart from any value and keeps its place."""
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys])


def group_class_violations(df: DataFrame, groups: Sequence[str], y: str) -> DataFrame:
    """Groups with one class only, or with a class of fewer than 2 rows."""
    subject = key_text(groups)
    per_class = df.groupBy(*groups, y).agg(F.count(F.lit(1)).alias("n"))
    per_group = per_class.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("classes"), F.min("n").alias("smallest")
    )
    few = per_group.where(F.col("classes") < 2).select(
        *_violation("single_class", subject, F.col("classes"))
    )
    small = per_group.where(F.col("smallest") < MIN_ROWS_PER_CLASS).select(
        *_violation("small_class", subject, F.col("smallest"))
    )
    return few.unionByName(small)


def unique_ratio_violations(df: DataFrame, col: str) -> DataFrame:
    """A continuous confound needs at least 10 % distinct values."""
    ratio = df.agg((F.count_distinct(col) / F.count(F.lit(1))).alias("value"))
    return ratio.where(F.col("value") < MIN_UNIQUE_RATIO).select(
        *_violation("unique_ratio", F.lit(col), F.col("value"))
    )


def proba_sum_violations(df: DataFrame, id_col: str, probas: str) -> DataFrame:
    total = F.aggregate(probas, F.lit(0.0), lambda a, x: a + x)
    bad = F.abs(total - 1) > PROBA_SUM_TOLERANCE
    return df.where(bad).select(*_violation("proba_sum", F.col(id_col), total))


def class_count_violations(df: DataFrame, by: Sequence[str], y: str, most: int = 2) -> DataFrame:
    """Groups whose label has more than ``most`` states."""
    n = df.groupBy(*by).agg(F.count_distinct(y).alias("n"))
    subject = key_text(by)
    return n.where(F.col("n") > most).select(*_violation("not_binary", subject, F.col("n")))


def duplicate_violations(df: DataFrame, col: str) -> DataFrame:
    n = df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return n.select(*_violation("duplicate", F.col(col), F.col("n")))


def all_violations(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def proba_guard(probas: Column) -> Column:
    """The vector itself, raising at run time when it does not sum to one."""
    total = F.aggregate(probas, F.lit(0.0), lambda a, x: a + x)
    ok = F.abs(total - 1) <= PROBA_SUM_TOLERANCE
    return F.when(ok, probas).otherwise(F.raise_error(F.lit("probabilities do not sum to one")))
