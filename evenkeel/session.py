"""Session helpers: the shared folder of the cluster and cutting long lineages."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, it is a fresh folder on Hadoop's default file system, which is
    removed when the application ends. A local file system is refused there unless
    executors run inside the driver, since other machines would not see it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or _made.get(spark.sparkContext.applicationId)
    if path:
        return path
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.FileSystem.get(hadoop)
    fresh = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"/tmp/evenkeel-{uuid.uuid4().hex}"))
    in_driver = spark.sparkContext.master.split("[")[0] == "local"
    if fresh.toUri().getScheme() == "file" and not in_driver:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    fs.mkdirs(fresh)
    fs.deleteOnExit(fresh)
    return _made.setdefault(spark.sparkContext.applicationId, fresh.toString())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut_lineage(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write the rows to the shared folder and read them back. Unlike a cache, the result
    survives the loss of any executor. ``codec`` is Parquet's compression, the session's if None."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query go when it ends, not when the driver collects its garbage. For steps that
    are stored, as what they read is not read again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)
