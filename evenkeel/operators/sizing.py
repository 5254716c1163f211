"""Size-checked broadcasting and order-preserving bucketing.

Nothing is broadcast on trust: a dimension is materialised through a row limit first,
and only a result that proves to be below the limit becomes a broadcast side. Larger
results stay distributed and the join shuffles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 50_000
MAX_BROADCAST_BYTES = 16 << 20
TARGET_ROWS_PER_BUCKET = 2_000_000
QUANTILES = 1023


def small_table(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> pa.Table | None:
    """The rows on the driver when they fit the bounds, otherwise None."""
    table = df.limit(max_rows + 1).toArrow()
    fits = table.num_rows <= max_rows and table.nbytes <= MAX_BROADCAST_BYTES
    return table if fits else None


def materialize_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame | None:
    """The rows as a local relation when they fit the bounds, otherwise None."""
    table = small_table(df, max_rows)
    return None if table is None else df.sparkSession.createDataFrame(table, schema=df.schema)


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` ready to be the small side of a join: broadcast when proven small."""
    local = materialize_small(df, max_rows)
    return df if local is None else F.broadcast(local)


def shuffle_buckets(spark: SparkSession) -> int:
    """Number of hash buckets per stratum: enough to spread one hot stratum over every
    shuffle task of the session."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(16, min(65535, 4 * parts))


@dataclass(frozen=True)
class ValueStats:
    """Row count, approximate distinct count, range and quantiles of one numeric column."""

    rows: int
    distinct: int
    lo: float
    hi: float
    quantiles: list[float]

    def splits(self, target_rows: int = TARGET_ROWS_PER_BUCKET) -> list[float]:
        """Ascending interior split points giving buckets of about ``target_rows``; empty
        when one bucket is enough. Split points are literals, so every branch of a plan
        buckets alike."""
        buckets = min(QUANTILES + 1, -(-self.rows // target_rows))
        if buckets <= 1 or not self.quantiles:
            return []
        step = len(self.quantiles) / buckets
        return sorted({self.quantiles[int(i * step)] for i in range(1, buckets)})

    def parts(self, target_rows: int = TARGET_ROWS_PER_BUCKET) -> int:
        """How often every bucket is cut again, evenly by value, where the quantiles alone
        leave it too large."""
        return max(1, -(-self.rows // (target_rows * (len(self.splits(target_rows)) + 1))))


def value_stats(df: DataFrame, values: Sequence[str]) -> dict[str, ValueStats]:
    """One pass of mergeable sketches over all columns; no row is shuffled."""
    probs = [i / (QUANTILES + 1) for i in range(1, QUANTILES + 1)]
    aggs = []
    for i, c in enumerate(values):
        v = F.col(c).cast("double")
        aggs += [
            F.count(v).alias(f"n{i}"), F.approx_count_distinct(v, 0.02).alias(f"d{i}"),
            F.percentile_approx(v, probs, 4 * QUANTILES).alias(f"q{i}"),
            F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
        ]
    row = df.agg(*aggs).first()
    return {
        c: ValueStats(
            row[f"n{i}"], row[f"d{i}"], row[f"lo{i}"], row[f"hi{i}"],
            [float(x) for x in row[f"q{i}"] or []],
        )
        for i, c in enumerate(values)
    }


def range_bucket(df: DataFrame, value: str, stats: ValueStats, out: str) -> DataFrame:
    """Add the bucket number of ``value``; buckets ascend with the value."""
    splits, parts = stats.splits(), stats.parts()
    if not splits:
        return df.withColumn(out, F.lit(0).cast("bigint"))
    edges = [float("-inf"), *splits, float("inf")]
    b = Bucketizer(splits=edges, inputCol=value, outputCol=out, handleInvalid="keep")
    df = b.transform(df).withColumn(out, F.col(out).cast("bigint"))
    if parts == 1:
        return df
    at = (F.col(out) + 1).cast("int")
    lo = F.try_element_at(F.array(*[F.lit(x) for x in [stats.lo, *splits]]), at)
    hi = F.try_element_at(F.array(*[F.lit(x) for x in [*splits, stats.hi]]), at)
    share = F.coalesce(F.try_divide(F.col(value) - lo, hi - lo), F.lit(0.0))
    part = F.least(F.greatest(F.floor(share * parts), F.lit(0)), F.lit(parts - 1))
    return df.withColumn(out, F.col(out) * parts + part)


def stratum(keys: Sequence[str]) -> Column:
    """Grouping keys as one struct; nulls inside compare equal."""
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
