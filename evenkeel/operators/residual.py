"""Regressing a confound out of numeric features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.contracts import ContractError, unique_ratio_violations
from evenkeel.operators.sizing import broadcast_if_small, stratum


def residualize_categorical(
    df: DataFrame, features: Sequence[str], group: str, suffix: str = "_res"
) -> DataFrame:
    """x - (mean of x in the row's group - overall mean of x).

    One partial aggregation gives every group's sums; the overall mean is a scalar
    subquery over those sums, so the data is read twice and shuffled at most once."""
    sums = df.groupBy(stratum([group]).alias("__s")).agg(
        *[F.sum(F.col(x).cast("double")).alias(f"__sum_{x}") for x in features],
        *[F.count(x).alias(f"__n_{x}") for x in features],
    )
    sums = broadcast_if_small(sums)
    total = sums.agg(
        F.struct(*[(F.sum(f"__sum_{x}") / F.sum(f"__n_{x}")).alias(x) for x in features])
    ).scalar()
    shifts = sums.select(
        "__s",
        *[
            (F.try_divide(f"__sum_{x}", f"__n_{x}") - total[x]).alias(f"__shift_{x}")
            for x in features
        ],
    )
    out = df.withColumn("__s", stratum([group])).join(shifts, "__s", "left")
    for x in features:
        out = out.withColumn(x + suffix, F.col(x) - F.col(f"__shift_{x}"))
    return out.drop("__s", *[f"__shift_{x}" for x in features])


def residualize_continuous(
    df: DataFrame, features: Sequence[str], confound: str, suffix: str = "_res",
    check: bool = True,
) -> DataFrame:
    """x - slope * c with the least-squares slope of x on c; the mean is kept.

    The slopes are one scalar subquery: a single aggregated row, no join."""
    if check and unique_ratio_violations(df, confound).take(1):
        raise ContractError(f"{confound} is not continuous: under 10 % distinct values")
    slopes = df.agg(
        F.struct(*[F.regr_slope(x, confound).alias(x) for x in features])
    ).scalar()
    out = df
    for x in features:
        out = out.withColumn(x + suffix, F.col(x) - slopes[x] * F.col(confound))
    return out
