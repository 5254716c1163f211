"""Documents to training shards: five stages, each written and read again before the next.

A stage decides on all rows that its predecessor kept and returns the columns of documents; the
last adds shard and slot, which replace columns of these names. Rows without a doc_id are kept by
the deduplicating stage, which names documents by it; the others judge each by its text. Columns beyond
those of documents pass through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenkeel.llm import decontaminate, language, mixing, neardup, sharding
from evenkeel.llm.common import word_count
from evenkeel.operators.sizing import broadcast_if_small
from evenkeel.session import cut_lineage

SHARDS = 16
CYCLE = (1, 2, 3)
SEED = 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter or text are rejected."""
    model = language.fit(docs, F.lit(True))
    found = language.predicted(model)(F.col("text"))
    marked = docs.withColumn("__lang", found).where(F.col("__lang.lang_pred") != language.UNKNOWN)
    return marked.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates stays, once."""
    found = neardup.near_duplicates(docs)
    gone = cut_lineage(found.where("not kept and doc_id is not null").select("doc_id").distinct(), "dropped")
    # the rows of a repeated id are one document
    again = cut_lineage(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    kept = docs.join(broadcast_if_small(gone), "doc_id", "left_anti")
    if not again.limit(1).count():
        return kept.select(*docs.columns)
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    once = kept.where("doc_id is not null").withColumn("__n", first).where("__n = 1").drop("__n")
    return once.unionByName(kept.where("doc_id is null")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least a twentieth of their words in benchmark windows go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")

    def clean(rows: DataFrame, key: str) -> DataFrame:
        found = decontaminate.find_contamination(rows, items, id_col=key, slop=None)
        gone = cut_lineage(found.where(decontaminate.contaminated()).select(key).distinct(), "contaminated")
        return rows.join(broadcast_if_small(gone), key, "left_anti").select(*docs.columns)

    lone = docs.where("doc_id is null")
    if not lone.limit(1).count():
        return clean(docs, "doc_id")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return clean(docs.where("doc_id is not null"), "doc_id").unionByName(clean(lone.withColumn("__digest", digest), "__digest"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(cut_lineage(sized, "word-counts"), CYCLE, "source", "size", ["doc_id"], seed=SEED)
    times = mixed.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size")).agg(F.max("copies").alias("__copies"))
    same = [
        F.col("doc_id").eqNullSafe(F.col("__id")), F.col("source").eqNullSafe(F.col("__source")),
        word_count(F.col("text")) == F.col("__size"),
    ]
    return mixing.emit(docs.join(times.where("__copies > 0"), same), docs.columns, "__copies")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot."""
    return sharding.place_rows(docs, shards=SHARDS)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the language mixtures and the packing; tests compare each stage with a
#: brute-force version instead.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
