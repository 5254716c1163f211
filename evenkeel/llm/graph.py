"""Connected components of distributed links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(v, root) of all ends of ``links`` (a, b): equal roots for connected ends.

    Links are contracted in rounds: every vertex moves to the neighbour that comes first in
    hash order, itself included, and links inside a moved group vanish. A star is done in one
    or two rounds and a chain loses a constant share of its links in each, whatever its ids.
    Groupings combine map-side, and joins on a vertex with very many links are split by
    adaptive execution."""
    edges = cut_lineage(links.where("a <> b").select("a", "b").distinct(), "links")
    labels = None
    while edges.limit(1).count():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        best = both.groupBy(F.col("a").alias("v")).agg(F.min(rank("b")).alias("best"))
        up = cut_lineage(best.select("v", F.least(rank("v"), F.col("best"))["v"].alias("up")), "moves")
        for end in ("a", "b"):
            edges = edges.join(up, edges[end] == up["v"]).drop(end, "v").withColumnRenamed("up", end)
        edges = cut_lineage(edges.where("a <> b").select("a", "b").distinct(), "links")
        if labels is None:
            labels = up.withColumnRenamed("up", "root")
        else:
            moved = labels.join(up.withColumnRenamed("v", "root"), "root", "left")
            labels = cut_lineage(moved.select("v", F.coalesce("up", "root").alias("root")), "labels")
    if labels is None:
        labels = edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return labels
