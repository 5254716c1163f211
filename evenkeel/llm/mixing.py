"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.hashing import hash52, unit_hash
from evenkeel.llm.common import running_total, skewed_lookup
from evenkeel.session import cut_lineage

MAX_REPEATS = 3
DRAWN_TOGETHER = 2000


def with_rank(values: DataFrame, column: str, out: str = "rank") -> DataFrame:
    """Number the rows of ``values`` (distinct values) from 0 in code point order, null last.

    Range partitions are numbered each for itself and shifted by the sizes of those before,
    so that no task sorts all values."""
    spark = values.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = values.repartitionByRange(parts, F.col(column).asc_nulls_last())
    dealt = cut_lineage(dealt.withColumn("__part", F.spark_partition_id()), "ranked-values")
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = running_total(sizes, "__n", ["__part"], "__before").drop("__n")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(F.col(column).asc_nulls_last()))
    return (
        dealt.withColumn("__in", within).join(before, "__part")
        .withColumn(out, (F.col("__before") + F.col("__in") - 1).cast("bigint"))
        .drop("__part", "__in", "__before")
    )


def cyclic_weights(sources: DataFrame, source: str, cycle: Sequence[float]) -> DataFrame:
    """Weight 1, 2, 3, 1, .. (for ``cycle`` 1, 2, 3) of the sources in code point order."""
    at = F.pmod(F.col("rank"), F.lit(len(cycle))).cast("int") + 1
    weights = F.array(*[F.lit(float(c)) for c in cycle])
    return with_rank(sources, source).withColumn("weight", F.element_at(weights, at)).drop("rank")


def targets(sources: DataFrame, cap: float = MAX_REPEATS) -> DataFrame:
    """Add ``target`` to ``sources`` (source_size, weight): the total size shared by weight,
    no source above ``cap`` times its size, the excess reshared by weight until none is above.

    Every round is one aggregation over the sources and brings three sums to the driver. A
    source without weight gets nothing. Read ``sources`` from storage."""
    room = F.col("source_size") * F.lit(float(cap))
    level = None
    while True:
        full = F.lit(False) if level is None else F.lit(level) * F.col("weight") > room
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, room).otherwise(0.0)).alias("capped"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not row.total or not row.open:
            break
        new = max(0.0, row.total - row.capped) / row.open
        if level is not None and new <= level:
            break
        level = new
    share = F.lit(float(level or 0.0)) * F.col("weight")
    return sources.withColumn("target", F.least(share, room).cast("double"))


def mix(
    sized: DataFrame, weights: DataFrame | Sequence[float], source: str, size: str,
    identity: Sequence[str], cap: float = MAX_REPEATS, seed: int | str = 0,
) -> DataFrame:
    """Add source_size, target, rate and ``copies`` to the rows of ``sized``.

    Sizes are summed per source, each source's rate is its target over its size, and every row
    gets floor(rate) copies and one more with probability equal to the fraction, drawn from
    hashes of ``identity`` and ``seed`` (see :func:`draw`): reruns and retries agree.
    ``weights`` is a table
    (source, weight) or a cycle of weights dealt to the sources in code point order. Null is a
    source of its own, the last one. Rows without size count as 0; a source of size 0 has
    target 0 and no copies. Repeated rows draw alike. An empty table gives an empty result.

    ``sized`` is read several times: pass a stored table."""
    # a null source is told apart from every text, also inside groupings and joins
    per = sized.groupBy(F.col(source).alias("__source")).agg(
        F.sum(F.coalesce(F.col(size), F.lit(0))).alias("source_size"), F.count(F.lit(1)).alias("n")
    )
    if isinstance(weights, DataFrame):
        per = per.join(
            weights.select(F.col(source).alias("__w"), F.col("weight").cast("double")),
            F.col("__source").eqNullSafe(F.col("__w")), "left",
        ).drop("__w").fillna(0.0, ["weight"])
    else:
        per = cyclic_weights(cut_lineage(per, "source-sizes"), "__source", weights)
    per = targets(cut_lineage(per, "source-weights"), cap)
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    salts = F.greatest(F.ceil(F.col("n") / DRAWN_TOGETHER), F.lit(1))
    per = per.withColumns({"rate": F.least(rate, F.lit(float(cap))), "salts": salts}).drop("weight")
    out = skewed_lookup(
        sized.withColumn("__source", F.col(source)), cut_lineage(per, "source-rates"), ["__source"], "n",
        sized.count(), F.struct(*identity),
    )
    return draw(out, size, identity, seed).drop("__source", "salts")


def draw(rated: DataFrame, size: str, identity: Sequence[str], seed: int | str) -> DataFrame:
    """Add ``copies``: floor(rate), and one more with probability equal to the fraction.

    A hash deals the rows of a source to groups of about DRAWN_TOGETHER. In a group, rows
    stand by size, and one hash-seeded number for all of them decides: row k gets a copy where
    k times the fraction plus that number passes a whole number. Each row's chance is the
    fraction as with a draw of its own, but rows of like size balance, which keeps a source's
    sum near its target even where it has few rows."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]
    order = hash52(*keys, seed)
    salted = rated.withColumns({"__h": order, "__salt": F.pmod(order, F.col("salts"))})
    at = F.row_number().over(Window.partitionBy("__source", "__salt").orderBy(size, "__h", *identity))
    begin = unit_hash(F.coalesce(F.col("__source").cast("string"), F.lit("")), F.col("__salt"), seed)
    whole = F.floor("rate")
    part, k = F.col("rate") - whole, F.col("__at")
    more = F.floor(part * k + F.col("__u")) - F.floor(part * (k - 1) + F.col("__u"))
    out = salted.withColumns({"__at": at, "__u": begin}).withColumn("copies", (whole + more).cast("bigint"))
    return out.drop("__h", "__salt", "__at", "__u")


def emit(mixed: DataFrame, columns: Sequence[str], copies: str = "copies") -> DataFrame:
    """Every row as often as its column ``copies`` says."""
    n = F.col(copies).cast("int")
    times = F.when(n > 0, F.array_repeat(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    return mixed.withColumn("__copy", F.explode(times)).select(*columns)
