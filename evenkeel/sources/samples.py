"""Sample tables: one table per split, stored as ``split=`` partitions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.errors import AnalysisException

from evenkeel.operators.contracts import ContractError

FORMATS = ("csv", "tsv", "json", "orc", "parquet")


def _reader(spark: SparkSession, path: str, fmt: str | None, schema: StructType | str | None):
    fmt = fmt or next((f for f in FORMATS if path.rstrip("/").endswith("." + f)), "parquet")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt in ("csv", "tsv"):
        raise ContractError("text tables need an explicit schema")
    if fmt in ("csv", "tsv"):
        reader = reader.option("header", True).option("sep", "\t" if fmt == "tsv" else ",")
        # Stringified lists contain the separator and are quoted.
        return reader.option("escape", '"').format("csv")
    return reader.format(fmt)


def read_table(
    spark: SparkSession, path: str, fmt: str | None = None, schema: StructType | str | None = None
) -> DataFrame:
    """A file, folder or glob; the format follows the path's extension."""
    return _reader(spark, path, fmt, schema).load(path)


def read_samples(
    spark: SparkSession, path: str, split: str | None = None, fmt: str | None = None,
    schema: StructType | str | None = None,
) -> DataFrame:
    """One sample table. With ``split`` only that partition's files are listed and read."""
    try:
        if split is None:
            return read_table(spark, path, fmt, schema)
        folder = f"{path.rstrip('/')}/split={split}"
        reader = _reader(spark, folder, fmt, schema).option("basePath", path)
        return reader.load(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise ContractError(f"no sample table at {path} (split {split})") from e
        raise


def read_holdouts(
    spark: SparkSession, paths: Mapping[str, str], fmt: str | None = None,
    schema: StructType | str | None = None,
) -> DataFrame:
    """Several tables in one frame, each row tagged with its table's name."""
    return tag_holdouts({n: read_table(spark, p, fmt, schema) for n, p in paths.items()})


def read_split_folders(
    spark: SparkSession, root: str, pattern: str = "test_*", fmt: str = "csv",
    schema: StructType | str | None = None,
) -> DataFrame:
    """Sibling folders ``<root>/<split>/`` as one frame, ``eval_set`` taken from the path.

    ``split=`` partitions are found the same way with the pattern ``split=test_*``."""
    df = _reader(spark, root, fmt, schema).load(f"{root.rstrip('/')}/{pattern}")
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return df.select("*", F.regexp_replace(folder, "^split=", "").alias("eval_set"))


def tag_holdouts(tables: Mapping[str, DataFrame], out: str = "eval_set") -> DataFrame:
    tagged = [df.withColumn(out, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def write_samples(df: DataFrame, out: str, split: str, fmt: str = "parquet") -> None:
    """Replace one split and leave the other partitions alone."""
    (
        df.withColumn("split", F.lit(split))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("split")
        .format(fmt)
        .save(out)
    )


def write_if_absent(df: DataFrame, out: str, overwrite: bool = False, fmt: str = "parquet") -> DataFrame:
    """Keep an existing result unless ``overwrite``; always return what is stored."""
    df.write.mode("overwrite" if overwrite else "ignore").format(fmt).save(out)
    return df.sparkSession.read.schema(df.schema).format(fmt).load(out)


def attach_features(
    df: DataFrame, features: DataFrame, id_col: str, vec: str, width: int, prefix: str = "p_"
) -> DataFrame:
    """Left-join a per-id numeric array and address its elements as columns. An array longer
    than ``width`` is an error, so that no element is lost; a shorter one gives nulls."""
    joined = df.join(features.select(id_col, vec), id_col, "left")
    fits = F.when(F.coalesce(F.size(vec), F.lit(0)) <= width, F.col(vec)).otherwise(
        F.raise_error(F.concat(F.lit(f"array wider than {width}: "), F.size(vec).cast("string"))).cast(joined.schema[vec].dataType)
    )
    joined = joined.withColumn(vec, fits)
    cells = [F.get(F.col(vec), F.lit(i)).alias(f"{prefix}{i}") for i in range(width)]
    return joined.select("*", *cells).drop(vec)


def explode_features(df: DataFrame, vec: str) -> DataFrame:
    """Array elements as (pos, value) rows."""
    keep = [c for c in df.columns if c != vec]
    return df.select(*keep, F.posexplode(vec).alias("pos", "value"))
