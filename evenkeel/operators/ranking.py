"""Exact ranks and exact top-k inside strata of any size.

A plain ``row_number`` over a stratum sorts it in one task. Here a stratum is cut into
order-preserving buckets; a histogram of (stratum, bucket) gives every bucket's offset,
and only rows of one bucket are ever sorted together. A cut at a quota needs no order at all:
histograms of ever longer hash prefixes find it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.hashing import HASH_BITS, hash52, hash_bucket
from evenkeel.operators.sizing import (
    ValueStats,
    broadcast_if_small,
    range_bucket,
    shuffle_buckets,
    stratum,
    value_stats,
)
from evenkeel.session import cut_lineage


def rank_in_strata(
    df: DataFrame,
    keys: Sequence[str],
    id_col: str,
    seed: str | int,
    rank: str = "rank",
    size: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Number the rows of every stratum 1..n in hash order of ``id_col`` (ties by id;
    ids must be unique within a stratum)."""
    b = buckets or shuffle_buckets(df.sparkSession)
    base = (
        df.withColumn("__s", stratum(keys))
        .withColumn("__h", hash52(F.col(id_col), seed))
        .withColumn("__b", hash_bucket(F.col("__h"), b))
    )
    hist = base.groupBy("__s", "__b").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy("__s")
    offsets = hist.select(
        "__s",
        "__b",
        (F.sum("__c").over(w.orderBy("__b")) - F.col("__c")).alias("__off"),
        F.sum("__c").over(w).alias("__n"),
    )
    inner = Window.partitionBy("__s", "__b").orderBy("__h", id_col)
    ranked = base.withColumn("__rn", F.row_number().over(inner)).join(offsets, ["__s", "__b"])
    out = ranked.withColumn(rank, F.col("__off") + F.col("__rn"))
    if size:
        out = out.withColumn(size, F.col("__n"))
    return out.drop("__s", "__b", "__h", "__rn", "__off", "__n")


#: Bits of the hash that one histogram tells apart, and rows that are few enough to be sorted.
PREFIX_BITS, FEW = 11, 64


def _deciding(rows: DataFrame, shift: int, need: Callable[[], Column]) -> DataFrame:
    """Stored (s, t, p, need, c): for each stratum and seed the hash prefix h >> shift that holds the
    row closing the quota, how many of its ``c`` rows are still needed, by one histogram."""
    w = Window.partitionBy("s", "t")
    hist = rows.groupBy("s", "t", F.shiftright("h", shift).alias("p")).agg(F.count(F.lit(1)).alias("c"), F.max("left").alias("left"))
    hist = hist.withColumn("hi", F.sum("c").over(w.orderBy("p"))).withColumn("n", F.sum("c").over(w)).withColumn("q", need())
    hist = hist.where((F.col("hi") >= F.col("q")) & (F.col("hi") - F.col("c") < F.col("q")))
    return cut_lineage(hist.select("s", "t", "p", (F.col("q") - F.col("hi") + F.col("c")).alias("need"), "c"), "cuts")


def stratum_cutoffs(
    df: DataFrame, keys: Sequence[str], id_col: str, seeds: Sequence[str | int],
    quota: Callable[[], Column], few: int = FEW, stored: bool = False,
) -> DataFrame:
    """For every stratum and seed the (hash, id) of the row closing the quota.

    ``quota`` returns a column over ``n`` (stratum size) and ``s`` (struct of keys).
    Result: one row per stratum, ``__cut`` maps the seed's position to (h, id).

    A radix selection: a histogram of hash prefixes finds the prefix that decides, and only its rows
    go on to the next bits, until at most ``few`` are left to be sorted. ``df`` is read once, for
    its keys and ids, unless it is ``stored`` already; rows are never shuffled but those few."""
    narrow = df.select(stratum(keys).alias("s"), F.col(id_col).alias("id"))
    narrow = narrow if stored else cut_lineage(narrow, "stratum-ids")
    hashes = F.array(*[hash52(F.col("id"), s) for s in seeds])
    rows = narrow.select("s", "id", F.posexplode(hashes).alias("t", "h")).withColumn("left", F.lit(0).cast("bigint"))
    shift, need = HASH_BITS - PREFIX_BITS, quota
    while True:
        cuts = _deciding(rows, shift, need)
        at = cuts.select("s", "t", "p", F.col("need").alias("__need"))
        rows = rows.withColumn("p", F.shiftright("h", shift)).join(broadcast_if_small(at), ["s", "t", "p"])
        rows = cut_lineage(rows.select("s", "id", "t", "h", F.col("__need").alias("left")), "deciding-rows")
        if not shift or not cuts.where(F.col("c") > few).limit(1).count():
            break
        shift, need = max(0, shift - PREFIX_BITS), lambda: F.col("left")
    order = F.row_number().over(Window.partitionBy("s", "t").orderBy("h", "id"))
    edge = rows.withColumn("rn", order).where(F.col("rn") == F.col("left"))
    entry = F.struct("t", F.struct("h", "id").alias("v"))
    return edge.groupBy("s").agg(F.map_from_entries(F.collect_list(entry)).alias("__cut"))


def flag_by_cutoffs(
    df: DataFrame, keys: Sequence[str], id_col: str, seeds: Sequence[str | int], cut: DataFrame, flags: Sequence[str]
) -> DataFrame:
    """Add one boolean per seed: does the row come no later than its stratum's cut?"""
    joined = df.withColumn("s", stratum(keys)).join(broadcast_if_small(cut), "s", "left")
    for i, (seed, flag) in enumerate(zip(seeds, flags)):
        at = F.element_at("__cut", F.lit(i))
        mine = F.struct(
            hash52(F.col(id_col), seed).alias("h"), F.col(id_col).alias("id")
        )
        joined = joined.withColumn(flag, F.coalesce(mine <= at, F.lit(False)))
    return joined.drop("s", "__cut")


def take_per_stratum(
    df: DataFrame,
    keys: Sequence[str],
    id_col: str,
    seeds: Sequence[str | int],
    quota: Callable[[], Column],
    flags: Sequence[str],
    few: int = FEW,
) -> DataFrame:
    """Add one boolean per seed: is the row within the first ``quota`` of its stratum?
    Ids must be unique within a stratum."""
    cut = stratum_cutoffs(df, keys, id_col, seeds, quota, few)
    return flag_by_cutoffs(df, keys, id_col, seeds, cut, flags)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per group. The ``row_number() <= n`` form lets Spark keep only n
    rows per group and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def value_ranks(
    df: DataFrame, keys: Sequence[str], value: str, extra: Sequence[Column] = (),
    stats: ValueStats | None = None,
) -> DataFrame:
    """Per (keys, value): row count ``n``, the number of rows ``below`` it, and any
    ``extra`` aggregates.

    Ties are collapsed first, so the ordered step sees distinct values only."""
    distinct = (
        df.where(F.col(value).isNotNull())
        .withColumns({"s": stratum(keys), "v": F.col(value).cast("double")})
        .groupBy("s", "v")
        .agg(F.count(F.lit(1)).alias("n"), *extra)
    )
    carried = distinct.columns[3:]
    stats = stats or value_stats(df, [value])[value]
    bucketed = range_bucket(distinct, "v", stats, "b")
    w = Window.partitionBy("s", "b").orderBy("v")
    within = bucketed.withColumn("below", F.sum("n").over(w) - F.col("n"))
    if stats.splits():
        ws = Window.partitionBy("s").orderBy("b")
        offs = bucketed.groupBy("s", "b").agg(F.sum("n").alias("c"))
        offs = offs.select("s", "b", (F.sum("c").over(ws) - F.col("c")).alias("off"))
        within = within.join(offs, ["s", "b"]).withColumn("below", F.col("below") + F.col("off"))
    return within.select("s", "v", "n", "below", *carried)


#: Values that a thousandth of all rows share are hot, so that there are at most a thousand in a column.
HOT = 1000


def run_ranks(cells: DataFrame) -> DataFrame:
    """Stored (s, i, v, n, rank): the average rank of each distinct value of ``cells`` (s, i, v) within
    (s, i), ties sharing their mean rank.

    Equal values are one run with a length. Runs are dealt by ranges of (i, s, v), and each range
    sums up lengths for itself; only what a group has in earlier ranges is added, at most one
    row per range. One range partitioning does for all groups and columns."""
    keys = ["i", "s", "v"]
    runs = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    dealt = cut_lineage(runs.repartitionByRange(*keys).withColumn("r", F.spark_partition_id()), "runs")
    before = Window.partitionBy("i", "s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("i", "s", "r").agg(F.sum("n").alias("c")).withColumn("off", F.sum("c").over(before))
    sums = sums.where("off is not null").select(F.col("i").alias("__i"), F.col("s").alias("__s"), F.col("r").alias("__r"), "off")
    within = F.sum("n").over(Window.partitionBy("i", "s", "r").orderBy("v")) - F.col("n")
    same = (F.col("i") == F.col("__i")) & (F.col("s") == F.col("__s")) & (F.col("r") == F.col("__r"))
    placed = dealt.withColumn("below", within).join(broadcast_if_small(sums), same, "left")
    rank = F.col("below") + F.coalesce("off", F.lit(0)) + (F.col("n") + 1) / 2
    return cut_lineage(placed.select(*keys, "n", rank.alias("rank")), "run-ranks")


def average_ranks(
    df: DataFrame, columns: Mapping[str, str], keys: Sequence[str] = ()
) -> DataFrame:
    """Add the average rank (ties share their mean rank) of several columns within
    ``keys``; ``columns`` maps each value column to its rank column. Null values have none.

    All columns go through the same steps as rows (row, column, value), so that the number of
    shuffles does not grow with them. Ranks come back to hot values by a broadcast of at most
    HOT runs a column, to others by a join on the value, and to the rows by one grouping."""
    rows = cut_lineage(df.withColumn("__row", F.monotonically_increasing_id()), "ranked-rows")
    cells = F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in columns]))
    long = rows.select("__row", stratum(keys).alias("s"), cells.alias("i", "v")).where("v is not null")
    # one zero, not two
    long = cut_lineage(long.withColumn("v", F.col("v") + 0.0), "cells")
    ranks = run_ranks(long)
    total = max(1, long.count() // max(1, len(columns)))
    hot = F.broadcast(ranks.where(F.col("n") * HOT >= total).select("i", "s", "v", "rank"))
    cold = ranks.where(F.col("n") * HOT < total).select("i", "s", "v", "rank")
    on = ["i", "s", "v"]
    met = long.join(hot, on).unionByName(long.join(hot.drop("rank"), on, "left_anti").join(cold, on))
    found = met.groupBy("__row").agg(*[F.max(F.when(F.col("i") == i, F.col("rank"))).alias(f"__rank{i}") for i in range(len(columns))])
    out = rows.join(found, "__row", "left")
    return out.select(*df.columns, *[F.col(f"__rank{i}").alias(c) for i, c in enumerate(columns.values())])
