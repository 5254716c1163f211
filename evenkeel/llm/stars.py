"""Linking members of shared buckets by star-shaped candidate pairs, without losing a link.

Only DataFrame functions are used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import skewed_lookup
from evenkeel.llm.graph import components
from evenkeel.session import cut_lineage

HUBS = 256
#: Members of the largest component that each other member is held against, by round, before the exact join.
TRIES = ()


def in_shared_buckets(dealt: DataFrame, total: int, marks: DataFrame) -> DataFrame:
    """(bucket, id, mark) of the rows of ``dealt`` (id, bucket), ``total`` of them, whose bucket
    has others; ``marks`` (id, mark) has each id once."""
    shared = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").withColumn("yes", F.lit(True))
    shared = cut_lineage(shared, "shared-buckets")
    members = skewed_lookup(dealt, shared, ["bucket"], "c", total, F.col("id")).where("yes")
    return cut_lineage(members.join(marks, "id").select("bucket", "id", "mark"), "bucket-members")


def earlier(of: str) -> Column:
    """The buckets of an id, within these rows, that come before a row's own."""
    return F.filter(F.collect_set("bucket").over(Window.partitionBy(of)), lambda b: b < F.col("bucket"))


def apart_from_main(named: DataFrame) -> DataFrame:
    """Rows (bucket, main, c) of the buckets of ``named`` (bucket, id, root, ..) with several roots:
    their most frequent root and their size."""
    parts = named.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    main = F.max_by("root", F.struct("c", F.xxhash64("root"))).alias("main")
    still = parts.groupBy("bucket").agg(main, F.count(F.lit(1)).alias("k"), F.sum("c").alias("c"))
    return cut_lineage(still.where("k > 1").drop("k"), "mixed-buckets")


def grouped(named: DataFrame, labels: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(id, main) of the members of ``named`` (bucket, id, root, ..) outside their bucket's largest
    component, and (id, main, pivot) of those and of all ids of that component; None where buckets
    have one component each. The pivot of a component is its id with most links.

    Two members of a bucket so meet under its main. Rows inside the largest component are
    counted, but not joined."""
    parts = cut_lineage(named.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c")), "bucket-roots")
    main = F.max_by("root", F.struct("c", F.xxhash64("root"))).alias("main")
    still = cut_lineage(parts.groupBy("bucket").agg(main, F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "mixed-buckets")
    if not still.limit(1).count():
        return None
    minor = cut_lineage(parts.join(still, "bucket").where("root <> main").select("bucket", "root", "main"), "minor-roots")
    apart = cut_lineage(named.join(minor, ["bucket", "root"]).select("id", "main").distinct(), "apart")
    ends = links.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("degree"))
    mains = still.select("main").distinct()
    inside = labels.join(mains.withColumnRenamed("main", "root"), "root", "left_semi").join(ends, "v")
    inside = cut_lineage(inside.select(F.col("v").alias("id"), F.col("root").alias("main"), "degree"), "main-members")
    pivot = inside.groupBy("main").agg(F.max_by("id", F.struct("degree", F.xxhash64("id"))).alias("pivot"))
    # an id without links is a component of its own
    pivot = cut_lineage(mains.join(pivot, "main", "left").select("main", F.coalesce("pivot", "main").alias("pivot")), "pivots")
    lone = mains.select(F.col("main").alias("id"), "main")
    others = inside.select("id", "main").unionAll(apart).unionAll(lone).distinct()
    return apart, others.join(pivot, "main")


def attempts(found: DataFrame, still: DataFrame, tries: int, salt: int, possible: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs (a, b) of members of ``found`` (bucket, id, mark, root, main, size) outside the largest
    component of a bucket with members inside, up to ``tries`` per id: a bucket each. In turn
    a hash chooses the bucket's member and its centrality does: who is like most others shares
    many and large buckets."""
    inside, central = found.where("root = main"), F.lit(0)
    if salt % 2:
        inside = inside.join(found.groupBy("id").agg(F.sum("size").alias("central")), "id")
        central = F.col("central")
    pick = F.max(F.struct(central.alias("central"), F.xxhash64("id", "bucket", F.lit(salt)).alias("place"), F.col("id").alias("rep"), F.col("mark").alias("rep_mark"))).alias("r")
    reps = inside.groupBy("bucket").agg(pick).select("bucket", "r.rep", "r.rep_mark")
    reps = cut_lineage(reps.join(still.select("bucket", "c"), "bucket"), "component-members")
    order = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("bucket", F.lit(salt))))
    chosen = found.where("root <> main").select("bucket", "id", "mark").withColumn("k", order).where(F.col("k") <= tries).drop("k")
    chosen = cut_lineage(chosen, "open-members")
    met = skewed_lookup(chosen, reps, ["bucket"], "c", max(1, chosen.count()), F.col("id")).where("rep is not null")
    met = met.where(possible(F.col("rep_mark"), F.col("mark")))
    return met.select(F.least("rep", "id").alias("a"), F.greatest("rep", "id").alias("b")).distinct()


def link(
    members: DataFrame, possible: Callable[[Column, Column], Column], confirmed: Callable[[DataFrame], DataFrame],
    exact: Callable[[DataFrame, DataFrame], DataFrame] | None = None, tries: tuple[int, ...] = TRIES, met: DataFrame | None = None,
) -> DataFrame:
    """(v, root) of all linked ids of ``members`` (bucket, id, mark), a stored table of buckets
    of at least two.

    ``possible`` tells from two marks whether a pair can be linked at all; ``confirmed`` keeps
    the linked ones of pairs (a, b). The pairs ``met`` (a, b) are compared with the first ones.

    In each bucket the id that comes first in a hash order of its own is the hub of a star: only
    pairs of the hub and another member are compared. Members of many common buckets so meet
    as many hubs. A hub has then been held against its whole bucket and leaves it. What
    stars miss is a link between members that both differ from the hub. Buckets whose members
    all are in one component are done. The others' members outside the largest component may try
    single members of it, in rounds of ``tries``; those still apart are held against that
    component and each other by ``exact``, which connects every linked (a, b) of the two tables of
    :func:`grouped` under one main. As those inside one component need no link, none is lost.

    Without ``exact`` the up to HUBS smallest members outside the largest component are hubs
    of further rounds, compared with all members of other components, until every two members
    of a bucket have been compared or are connected."""
    place = F.xxhash64("id", "bucket")
    first = F.min(F.struct(place.alias("place"), F.col("id").alias("hub"), F.col("mark").alias("hub_mark"))).alias("h")
    hubs = cut_lineage(members.groupBy("bucket").agg(first, F.count(F.lit(1)).alias("c")).select("bucket", "h.hub", "h.hub_mark", "c"), "hubs")
    stars = skewed_lookup(members, hubs, ["bucket"], "c", members.count(), F.col("id")).where("id <> hub")
    stars = cut_lineage(stars, "stars")
    pairs = stars.where(possible(F.col("hub_mark"), F.col("mark"))).select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b"))
    pairs = pairs.unionAll(met) if met is not None else pairs
    links = cut_lineage(confirmed(cut_lineage(pairs.distinct(), "pairs")), "confirmed")
    members = stars.select("bucket", "id", "mark")
    for n in range(len(tries) + 1 if exact else 0):
        labels = cut_lineage(components(links), "components")
        named = members.join(labels.withColumnRenamed("v", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        named = cut_lineage(named, "members")
        if n == len(tries):
            met = grouped(named, labels, links)
            if met is None:
                return labels
            return components(links.unionAll(cut_lineage(exact(*met).select("a", "b"), "confirmed")))
        still = apart_from_main(named)
        if not still.limit(1).count():
            return labels
        sized = still.withColumn("size", F.col("c"))
        found = skewed_lookup(named, sized, ["bucket"], "c", named.count(), F.col("id")).where("main is not null")
        members = cut_lineage(found, "open-buckets")
        met = attempts(members, still, tries[n], n, possible)
        links = links.unionAll(cut_lineage(confirmed(cut_lineage(met, "pairs")), "confirmed"))
        members = members.select("bucket", "id", "mark")
    while True:
        labels = cut_lineage(components(links), "components")
        named = members.join(labels.withColumnRenamed("v", "id"), "id", "left")
        named = cut_lineage(named.withColumn("root", F.coalesce("root", "id")), "members")
        still = apart_from_main(named)
        if not still.limit(1).count():
            return labels
        found = skewed_lookup(named, still, ["bucket"], "c", named.count(), F.col("id")).where("main is not null")
        found = cut_lineage(found.withColumn("earlier", earlier("id")), "open-members")
        order = F.row_number().over(Window.partitionBy("bucket").orderBy("id"))
        chosen = found.where("root <> main").withColumn("k", order).where(F.col("k") <= HUBS)
        chosen = cut_lineage(
            chosen.select("bucket", F.col("id").alias("hub"), F.col("mark").alias("hub_mark"), F.col("root").alias("hub_root"))
            .withColumn("hub_earlier", earlier("hub")), "next-hubs")
        apart = F.col("root") != F.col("hub_root")
        again = F.arrays_overlap("hub_earlier", "earlier")
        met = found.join(chosen, "bucket").where(apart & possible(F.col("hub_mark"), F.col("mark")) & ~again)
        met = met.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
        links = links.unionAll(cut_lineage(confirmed(cut_lineage(met, "pairs")), "confirmed"))
        gone = chosen.select("bucket", F.col("hub").alias("id"))
        members = found.select("bucket", "id", "mark").join(gone, ["bucket", "id"], "left_anti")
