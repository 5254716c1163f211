"""Exact deduplication by a tree-merge of digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import skewed_lookup, text_of
from evenkeel.session import cut_lineage

RUNS = 64
FAN_IN = 4
KEY = ("digest", "check")


def digest_columns(text: Column) -> dict[str, Column]:
    """SHA-256 of the text, and a second, independent hash with the length: two texts count
    as equal only where all of them agree."""
    return {
        "digest": F.unhex(F.sha2(text.cast("binary"), 256)),
        "check": F.struct(F.xxhash64(text).alias("h"), F.octet_length(text).alias("bytes")),
    }


def merge_runs(rows: DataFrame, keep: str, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """(digest, check, keep_id, group_size) of ``rows`` (id, digest, check).

    Every row belongs to a run, dealt out by its id. The first level makes each run's
    distinct digests, then every round merges ``fan_in`` neighbouring runs into one, keeping
    the smallest (or largest) id of digests whose second hash agrees, until one run is left.
    A digest that a third of all rows share is thus counted by many tasks first and never
    brings more than ``fan_in`` rows per task to a merge."""
    pick = F.min if keep == "min" else F.max
    run = F.pmod(F.xxhash64("id"), F.lit(runs)).cast("int").alias("run")
    level = rows.groupBy(run, *KEY).agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    while runs > 1:
        up = F.floor(F.col("run") / fan_in).cast("int").alias("run")
        level = level.groupBy(up, *KEY).agg(
            pick("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
        )
        runs = -(-runs // fan_in)
    return level.drop("run")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min"
) -> DataFrame:
    """(id, keep_id, group_size, kept, digest as lowercase hex), one row per row of ``docs``.

    Of equal texts the smallest (``keep="min"``) or largest (``"max"``) id stays. A null text
    is an empty one. Rows without an id are counted, and stay only where their whole group has
    none. Repeated rows of one id are one document and marked alike. An empty table gives an
    empty result. Other columns are not read."""
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be min or max, not {keep!r}")
    rows = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("t"))
    rows = cut_lineage(rows.select("id", *[c.alias(k) for k, c in digest_columns(F.col("t")).items()]), "digests")
    groups = cut_lineage(
        merge_runs(rows, keep).withColumn("n", F.col("group_size")), "digest-groups"
    )
    out = skewed_lookup(rows, groups, KEY, "n", rows.count(), F.col("id"))
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("digest"),
    )
