"""Running scores and rule draws over unbounded input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from evenkeel.operators.metrics import score
from evenkeel.operators.rules import draw_category, rule_probas
from evenkeel.session import scratch_path


def read_stream(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Files arriving at ``path`` as a stream with the schema of those present.

    A folder is watched as it is. Of a single file, its folder is watched for that name."""
    schema = spark.read.format(fmt).load(path).schema
    stream = spark.readStream.schema(schema).format(fmt)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        return stream.option("pathGlobFilter", target.getName()).load(target.getParent().toString())
    return stream.load(path)


def stream_scores(
    stream: DataFrame, y: str, p: str, by: Sequence[str],
    metrics: Sequence = ("d2", "logodds_mse", "logodds_mae", "accuracy"),
) -> DataFrame:
    """Running metrics per group. The state is a few sums per group, whatever has passed."""
    return score(stream, y, p, by, metrics)


def stream_assign(
    stream: DataFrame, rules: DataFrame, child: str, parents: Sequence[str], k: int, id_col: str,
    seed: str | int = 42,
) -> DataFrame:
    """Stateless rule lookup and draw on a stream."""
    scored = rule_probas(stream, rules, child, parents, k, "__p")
    return draw_category(scored, "__p", id_col, child, seed).drop("__p")


def drain_groups(result: DataFrame, name: str) -> DataFrame:
    """Process what is available and return the final groups (one row per group), which every
    batch writes anew to the shared folder."""
    spark = result.sparkSession
    out = scratch_path(spark, name)
    query = (
        result.writeStream.outputMode("complete")
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
        .option("checkpointLocation", scratch_path(spark, name + "-log"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


def drain_rows(result: DataFrame, name: str) -> DataFrame:
    """Process what is available into files of the shared folder and read them back."""
    spark = result.sparkSession
    out = scratch_path(spark, name)
    query = (
        result.writeStream.outputMode("append").format("parquet")
        .option("path", out).option("checkpointLocation", scratch_path(spark, name + "-log"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(out)
