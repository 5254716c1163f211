"""Run results and training-checkpoint logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evenkeel.functions.names import unpack_name
from evenkeel.functions.text import parse_list
from evenkeel.plans.reports import RUN_ORDER
from evenkeel.sources.samples import read_table

def read_effect_tables(
    spark: SparkSession, path_glob: str, schema: StructType | str, label: str = "lbl_y",
    prefix: str | None = None,
) -> DataFrame:
    """P(label) of many data sets stacked with the effects parsed from their file names:
    (name, con_name, cX, cy, Xy, proba). Files that cannot be read are skipped."""
    df = (
        spark.read.schema(schema).option("header", True).option("escape", '"')
        .option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).csv(path_glob)
    )
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    rows = df.select(name.alias("name"), parse_list(F.col(f"probas_{label}")).alias("p"))
    f = unpack_name(F.col("name"), prefix=prefix)
    return rows.withColumn("f", f).select(
        "name", F.get("f.cons", F.lit(0)).alias("con_name"), F.col("f.cX").alias("cX"),
        F.get("f.cys", F.lit(0)).alias("cy"), F.col("f.Xy").alias("Xy"),
        F.try_element_at("p", F.lit(2)).alias("proba"),
    )


# File names inside a checkpoint folder (fixed values).
METADATA_FILE = "metadata.tsv"
METRICS_FILE = "metametadata.json"


def union_runs(tables: Sequence[DataFrame]) -> DataFrame:
    """Concatenate run tables; columns missing somewhere become null; key columns first."""
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    keys = [c for c in RUN_ORDER if c in df.columns]
    return df.select(*keys, *[c for c in df.columns if c not in keys])


def collect_runs(
    spark: SparkSession, path_glob: str, fmt: str | None = None,
    schema: StructType | str | None = None,
) -> DataFrame:
    """All per-run files under a glob as one table in run order."""
    df = union_runs([read_table(spark, path_glob, fmt, schema)])
    return df.orderBy(*[c for c in RUN_ORDER if c in df.columns])


def _folder(path):
    return F.regexp_replace(path, r"/[^/]*$", "")


def read_checkpoint_logs(
    spark: SparkSession, root: str, metadata_schema: StructType | str, depth: str = "*/*"
) -> DataFrame:
    """Per-row checkpoint metadata joined with the checkpoint's metrics by folder.

    Adds ``checkpoint`` (folder), ``metrics`` map<string, double>."""
    base = f"{root.rstrip('/')}/{depth}"
    here = _folder(F.col("_metadata.file_path")).alias("checkpoint")
    rows = (
        spark.read.schema(metadata_schema).option("sep", "\t").option("header", True)
        .csv(f"{base}/{METADATA_FILE}").select("*", here)
    )
    return rows.join(read_checkpoint_metrics(spark, root, depth), "checkpoint")


def read_checkpoint_metrics(spark: SparkSession, root: str, depth: str = "*/*") -> DataFrame:
    """(checkpoint, metrics) of every checkpoint folder."""
    here = _folder(F.col("_metadata.file_path")).alias("checkpoint")
    return (
        spark.read.schema("metrics map<string,double>").option("multiLine", True)
        .json(f"{root.rstrip('/')}/{depth}/{METRICS_FILE}").select(here, "metrics")
    )
