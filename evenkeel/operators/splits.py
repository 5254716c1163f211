"""Train/test splits, folds and samples; all reproducible from (id, seed)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.hashing import hash52
from evenkeel.operators.contracts import require_no_rows
from evenkeel.operators.ranking import rank_in_strata, take_per_stratum, top_n


def _share(fraction: float):
    return lambda: F.round(F.lit(fraction) * F.col("n")).cast("bigint")


def stratified_holdout(
    df: DataFrame, y: str, id_col: str, fraction: float = 0.2, seed: str | int = 42,
    out: str = "part",
) -> DataFrame:
    """Mark ``fraction`` of every class as 'test', the rest as 'train'."""
    flagged = take_per_stratum(df, [y], id_col, [seed], _share(fraction), ["__t"])
    return flagged.withColumn(out, F.when(F.col("__t"), "test").otherwise("train")).drop("__t")


def stratified_kfold(
    df: DataFrame, y: str, id_col: str, k: int, seed: str | int = 42, out: str = "fold"
) -> DataFrame:
    """Give every row the one fold in which it is a test row; folds are class-balanced."""
    ranked = rank_in_strata(df, [y], id_col, seed, rank="__r")
    return ranked.withColumn(out, ((F.col("__r") - 1) % k).cast("bigint")).drop("__r")


def fold_parts(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """One row per (row, trial) with ``part`` = 'test' in its own fold, else 'train'."""
    trials = F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>")
    out = df.withColumn("trial", F.explode(trials))
    return out.withColumn(
        "part", F.when(F.col("trial") == F.col(fold), "test").otherwise("train")
    )


def repeated_shuffle_split(
    df: DataFrame, y: str, id_col: str, k: int, fraction: float = 0.1, seed: str | int = 42
) -> DataFrame:
    """k independent stratified splits as columns ``trial_0..`` holding 'train'/'val'."""
    names = [f"trial_{i}" for i in range(k)]
    seeds = [f"{seed}:{i}" for i in range(k)]
    out = take_per_stratum(df, [y], id_col, seeds, _share(fraction), names)
    for c in names:
        out = out.withColumn(c, F.when(F.col(c), "val").otherwise("train"))
    return out


def split_long(assign: DataFrame, id_col: str, k: int) -> DataFrame:
    """Wide trial columns to (id, trial, part)."""
    parts = F.posexplode(F.array(*[f"trial_{i}" for i in range(k)]))
    return assign.select(id_col, parts.alias("trial", "part"))


def check_assigned(assign: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Raise when any row misses a split."""
    bad = F.lit(False)
    for c in cols:
        bad = bad | ~F.coalesce(F.col(c).isin("train", "val"), F.lit(False))
    require_no_rows(assign.where(bad), "rows without a split")
    return assign


def capped_sample(df: DataFrame, id_col: str, n: int, seed: str | int = 42) -> DataFrame:
    """Simple random sample of at most ``n`` rows: the n smallest hashes."""
    return (
        df.withColumn("__h", hash52(F.col(id_col), seed))
        .orderBy("__h", id_col)
        .limit(n)
        .drop("__h")
    )


def group_sample(
    df: DataFrame, keys: Sequence[str], id_col: str, n: int, seed: str | int = 42
) -> DataFrame:
    """At most ``n`` random rows of every group."""
    h = hash52(F.col(id_col), seed)
    return top_n(df.withColumn("__h", h), keys, [F.col("__h"), F.col(id_col)], n).drop("__h")


def representative_row(df: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """The first row of every value after ordering by ``order``."""
    row = F.struct(*[F.col(c) for c in order], *[c for c in df.columns if c not in order])
    best = df.groupBy(value).agg(F.min(row).alias("__r"))
    return best.select(*[F.col(f"__r.{c}").alias(c) for c in df.columns])


def thin_values(df: DataFrame, value: str, n: int = 7, seed: str | int = 42) -> DataFrame:
    """At most ``n`` distinct values: the first, the last and random inner ones."""
    distinct = df.select(value).where(F.col(value).isNotNull()).distinct()
    ends = distinct.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    ranked = distinct.withColumn(
        "__end", (F.col(value) == ends["lo"]) | (F.col(value) == ends["hi"])
    ).withColumn("__h", hash52(F.col(value), seed))
    picked = ranked.orderBy(F.desc("__end"), "__h", value).limit(n)
    return picked.select(value)
