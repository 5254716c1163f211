"""Counterbalancing: equal class sizes inside every confound group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.hashing import hash52, unit_hash
from evenkeel.operators.contracts import (
    MAX_CONFOUND_CATEGORIES,
    MIN_ROWS_PER_CLASS,
    ContractError,
    all_violations,
    cardinality_violations,
    group_class_violations,
    key_text,
    require_columns,
)
from evenkeel.operators.features import category_codes
from evenkeel.operators.ranking import flag_by_cutoffs, rank_in_strata, stratum_cutoffs
from evenkeel.operators.sizing import broadcast_if_small
from evenkeel.session import cut_lineage

# Draws are generated in chunks so that a large deficit is spread over many tasks.
DRAW_CHUNK = 250_000


def group_code(df: DataFrame, confounds: Sequence[str], out: str = "group") -> DataFrame:
    """Sum of category_code_i * 10**i, categories in sorted order, 2..10 per confound."""
    require_columns(df, confounds)
    code = F.lit(0).cast("bigint")
    for i, c in enumerate(confounds):
        codes = category_codes(df, c, limit=10, least=2)
        code = code + codes(F.col(c)) * (10**i)
    return df.withColumn(out, code)


def counterbalance_down(
    df: DataFrame, y: str, id_col: str, groups: Sequence[str] = (), seed: str | int = 42,
    within: Sequence[str] = (),
) -> DataFrame:
    """In each group keep as many rows of every class as its smallest class has.

    The smallest class stays whole; the others are sampled without replacement. Tables stacked
    with the columns ``within`` are balanced each for itself, as if they were alone."""
    keys = [*within, *groups, y]
    narrow = cut_lineage(df.select(*dict.fromkeys([*keys, id_col])), "stratum-ids")
    cut = _smallest_class_cut(narrow, groups, y, id_col, seed, within)
    return flag_by_cutoffs(df, keys, id_col, [seed], cut, ["__keep"]).where("__keep").drop("__keep")


def _smallest_class_cut(
    narrow: DataFrame, groups: Sequence[str], y: str, id_col: str, seed: str | int, within: Sequence[str]
) -> DataFrame:
    """Where each class of the stored ``narrow`` is cut to the size of its group's smallest."""
    peers = Window.partitionBy("t", F.struct(F.lit(0), *[f"s.{g}" for g in [*within, *groups]]))
    return stratum_cutoffs(narrow, [*within, *groups, y], id_col, [seed], lambda: F.min("n").over(peers), stored=True)


def counterbalance_up(
    df: DataFrame, y: str, id_col: str, groups: Sequence[str] = (), seed: str | int = 42,
    within: Sequence[str] = (),
) -> DataFrame:
    """Keep all rows and add draws with replacement until every class of a group is as
    large as its largest class. ``within`` as in :func:`counterbalance_down`."""
    keys = [*within, *groups, y]
    narrow = cut_lineage(df.select(*dict.fromkeys([*keys, id_col])), "stratum-ids")
    return repeated(df, keys, id_col, 1 + F.coalesce("__more", F.lit(0)), _copies(narrow, groups, y, id_col, seed, within))


def _copies(
    narrow: DataFrame, groups: Sequence[str], y: str, id_col: str, seed: str | int, within: Sequence[str]
) -> DataFrame:
    """(__k, __more): how often rows of the stored ``narrow`` are drawn once more, until every class
    of a group is as large as its largest; __k holds the row's keys and id."""
    drawn, keys = [*groups, y], [*within, *groups, y]
    sizes = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    largest = F.max("__n").over(Window.partitionBy(F.struct(F.lit(0), *within, *groups)))
    short = (
        sizes.withColumn("__need", largest - F.col("__n"))
        .where(F.col("__need") > 0)
        .select(F.struct(*keys).alias("__k"), "__n", "__need")
    )
    short = broadcast_if_small(short)
    last = F.floor((F.col("__need") - 1) / F.lit(DRAW_CHUNK)).cast("bigint")
    start = F.col("__chunk") * F.lit(DRAW_CHUNK)
    draws = (
        short.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .repartition("__k", "__chunk")
        .withColumn(
            "__i",
            F.explode(F.sequence(start + 1, F.least(start + DRAW_CHUNK, F.col("__need")))),
        )
        .withColumn("__u", unit_hash(key_text([f"__k.{k}" for k in drawn]), F.col("__i"), seed))
        .select("__k", (F.floor(F.col("__u") * F.col("__n")) + 1).alias("__r"))
    )
    times = draws.groupBy("__k", "__r").agg(F.count(F.lit(1)).alias("__more"))
    pool = narrow.withColumn("__k", F.struct(*keys)).join(short.select("__k"), "__k", "left_semi")
    ranked = rank_in_strata(pool, keys, id_col, seed, rank="__r")
    return times.join(ranked, ["__k", "__r"]).select(_row_key(keys, id_col).alias("__k"), "__more")


def _row_key(keys: Sequence[str], id_col: str) -> Column:
    """A row's stratum and id as one; nulls inside compare equal."""
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate([*keys, id_col])])


def repeated(df: DataFrame, keys: Sequence[str], id_col: str, times: Column, copies: DataFrame) -> DataFrame:
    """Every row of ``df`` as often as ``times`` says, an expression that may use the row's __more
    from ``copies`` (__k, __more)."""
    met = df.withColumn("__k", _row_key(keys, id_col)).join(broadcast_if_small(copies), "__k", "left")
    each = F.explode(F.array_repeat(F.lit(0), times.cast("int")))
    return met.select(*df.columns, each.alias("__i")).drop("__i")


def counterbalance_mixed(
    df: DataFrame, y: str, id_col: str, groups: Sequence[str] = (), seed: str | int = 42,
    within: Sequence[str] = (),
) -> DataFrame:
    """Each group goes up or down by the parity of its hash.

    ``df`` is read twice: for its keys and ids, which both directions share, and for its rows."""
    keys = [*within, *groups, y]
    up = hash52(key_text(groups), seed) % 2 == 1
    narrow = cut_lineage(df.select(*dict.fromkeys([*keys, id_col])), "stratum-ids")
    copies = _copies(narrow.where(up), groups, y, id_col, seed, within)
    cut = _smallest_class_cut(narrow.where(~up), groups, y, id_col, seed, within)
    flagged = flag_by_cutoffs(df, keys, id_col, [seed], cut, ["__keep"])
    times = F.when(up, 1 + F.coalesce("__more", F.lit(0))).otherwise(F.col("__keep").cast("int"))
    return repeated(flagged, keys, id_col, times, copies).drop("__keep")


METHODS = {
    "downsample": counterbalance_down,
    "upsample": counterbalance_up,
    "resample": counterbalance_mixed,
}


def control_confounds(
    df: DataFrame,
    method: str | None,
    y: str,
    id_col: str,
    groups: Sequence[str] = (),
    balance_by: str | None = None,
    seed: str | int = 42,
) -> tuple[DataFrame, bool]:
    """Apply a confound control; (unchanged data, False) when a group cannot be balanced.

    ``method`` None is the baseline. Without ``groups`` the table is one group; without
    ``balance_by`` the label is balanced."""
    if method is None:
        return df, True
    if method not in METHODS:
        raise ContractError(f"confound control must be one of {sorted(METHODS)}, not {method!r}")
    require_columns(df, [*groups, y])
    by = balance_by or y
    if groups and cardinality_violations(df, groups).take(1):
        raise ContractError("every confound needs 2 to 10 categories")
    if group_class_violations(df, groups, by).take(1):
        return df, False
    return METHODS[method](df, by, id_col, groups, seed), True


def balanced_times(
    df: DataFrame, method: str, y: str, id_col: str, groups: Sequence[str], folds: int,
    fold: str = "fold", seed: str | int = 42,
) -> tuple[DataFrame, list[int]]:
    """((id, trial, times), trials that cannot be balanced): how often each row of ``df`` is in the
    balanced training set of each trial, that of all rows of other folds.

    All trials are balanced together, with the rows that :func:`control_confounds` takes for
    each."""
    if method not in METHODS:
        raise ContractError(f"confound control must be one of {sorted(METHODS)}, not {method!r}")
    trials = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    rows = df.select(id_col, y, *groups, fold).withColumn("trial", trials).where(F.col(fold) != F.col("trial"))
    sizes = rows.groupBy("trial", *groups, y).agg(F.count(F.lit(1)).alias("n"))
    sizes = cut_lineage(sizes, "class-sizes")
    if groups:
        combos = sizes.select("trial", *groups).distinct()
        found = combos.groupBy("trial").agg(*[F.count_distinct(g).alias(f"c{i}") for i, g in enumerate(groups)])
        odd = [(F.col(f"c{i}") < 2) | (F.col(f"c{i}") > MAX_CONFOUND_CATEGORIES) for i in range(len(groups))]
        if found.where(reduce(lambda a, b: a | b, odd)).take(1):
            raise ContractError("every confound needs 2 to 10 categories")
    each = sizes.groupBy("trial", *groups).agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("smallest"))
    bad = each.where((F.col("classes") < 2) | (F.col("smallest") < MIN_ROWS_PER_CLASS)).select("trial").distinct()
    refused = sorted(r.trial for r in bad.collect())
    rows = rows.where(~F.col("trial").isin(refused)) if refused else rows
    kept = METHODS[method](rows, y, id_col, groups, seed, ["trial"])
    return kept.groupBy(id_col, "trial").agg(F.count(F.lit(1)).alias("times")), refused


def balance_report(df: DataFrame, y: str, groups: Sequence[str]) -> DataFrame:
    """Everything that would stop a control, as rows."""
    return all_violations(
        cardinality_violations(df, groups), group_class_violations(df, groups, y)
    )
