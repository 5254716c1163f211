"""Merkle manifest of a dataset: per level, lag and lead windows supply siblings.

Only DataFrame functions are used."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import skewed_lookup
from evenkeel.llm.order import positions
from evenkeel.operators.sizing import broadcast_if_small
from evenkeel.session import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 2
#: Nodes of one block, all of whose levels one window partition holds.
BLOCK = 1024
PATH = "array<struct<left:string,right:string>>"


def digest_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def framed(value: Column) -> Column:
    """The value in decimal or as text with its length in UTF-8 bytes before; '-' for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: Sequence[str], changed: Mapping[str, Column] | None = None) -> Column:
    """Digest of the framed fields, some of them replaced by ``changed``."""
    return digest_of(F.concat(*[framed((changed or {}).get(f, F.col(f"`{f}`"))) for f in fields]))


def climb_blocks(nodes: DataFrame, group: Sequence[str], fan: int, height: int) -> DataFrame:
    """``nodes`` (group.., pos, n, digest, ..) with block, top and path.

    A block holds fan**height neighbouring nodes of a group of ``n``. At each level the row of a
    node's first leaf stands for it, so that siblings are at fixed distances: lag and lead
    columns, masked by the node's slot in its run and by the run's length. Rows in slot 0 hash
    the run to the parent; the last run may be shorter, and a group that has come to one node
    climbs no further. ``top`` is the block's own node, at its first row; ``path`` has the
    digests left and right of the node at each level, for every row below it."""
    rows = nodes.withColumn("block", F.floor(F.col("pos") / F.lit(fan**height)).cast("bigint")).withColumn("top", F.col("digest"))
    block = Window.partitionBy(*group, "block").orderBy("pos")
    levels, kept = [], [c for c in rows.columns if c != "top"]
    for level in range(height):
        step, known = fan**level, [*kept, *levels]
        left, right = [f"__lag{j}" for j in range(1, fan)], [f"__lead{j}" for j in range(1, fan)]
        rows = rows.select(
            *known, "top", *[F.lag("top", j * step).over(block).alias(c) for j, c in enumerate(left, 1)],
            *[F.lead("top", j * step).over(block).alias(c) for j, c in enumerate(right, 1)],
        )
        place = F.floor(F.col("pos") / F.lit(step))
        slot = place % fan
        run = F.least(F.lit(fan), F.ceil(F.col("n") / F.lit(step)) - (place - slot))
        many = F.col("n") > step
        own = many & (F.col("pos") % step == 0)
        before = F.concat(*[F.when(slot >= j, F.col(c)).otherwise("") for j, c in reversed([*enumerate(left, 1)])])
        after = F.concat(*[F.when(slot + j < run, F.col(c)).otherwise("") for j, c in enumerate(right, 1)])
        parent = F.when(own & (slot == 0), digest_of(F.concat("top", after))).when(~many, F.col("top"))
        levels.append(f"__level{level}")
        rows = rows.select(*known, parent.alias("top"), F.when(own, F.struct(before.alias("left"), after.alias("right"))).alias(levels[-1]))
    below = block.rowsBetween(Window.unboundedPreceding, 0)
    path = F.array_compact(F.array(*[F.last(c, True).over(below) for c in levels])).cast(PATH)
    return rows.select(*kept, "top", path.alias("path"))


def same(a: DataFrame, keys: Sequence[str], at: str) -> list[Column]:
    return [*[F.col(k).eqNullSafe(F.col(f"__up_{k}")) for k in keys], F.col(at) == F.col("__up_pos")]


def climb(nodes: DataFrame, group: Sequence[str], fan: int, block: int = BLOCK) -> list[DataFrame]:
    """Stored tables of all rounds, each as :func:`climb_blocks` returns it, from ``nodes`` to
    the round in which every group is one block. Its nodes are the tops of the round before."""
    height = 1
    while fan ** (height + 1) <= block:
        height += 1
    rounds = []
    while True:
        rounds.append(cut_lineage(climb_blocks(nodes, group, fan, height), "merkle-blocks"))
        tops = rounds[-1].where(F.col("pos") % fan**height == 0)
        if not tops.where("block > 0").limit(1).count():
            return rounds
        nodes = tops.select(*group, F.col("block").alias("pos"), F.ceil(F.col("n") / F.lit(fan**height)).cast("bigint").alias("n"), F.col("top").alias("digest"))


def with_upper(rows: DataFrame, upper: DataFrame, group: Sequence[str], values: Sequence[str] = ()) -> DataFrame:
    """Each row's path goes on with that of its block, which is a node of ``upper``."""
    up = upper.select(*[F.col(k).alias(f"__up_{k}") for k in group], F.col("pos").alias("__up_pos"), F.col("path").alias("__rest"), *values)
    found = rows.join(broadcast_if_small(up), same(rows, group, "block"), "left")
    return found.withColumn("path", F.concat("path", F.coalesce("__rest", F.array().cast(PATH)))).select(*rows.columns, *values)


def descend(rounds: Sequence[DataFrame], group: Sequence[str], values: Sequence[str] = ()) -> DataFrame:
    """The first of ``rounds`` with paths to the end of the last, which has ``values``."""
    upper = rounds[-1]
    for lower in reversed(rounds[:-1]):
        upper = with_upper(lower, cut_lineage(upper, "upper-paths"), group, values)
    return upper


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` give."""
    return F.aggregate(path, leaf, lambda node, x: digest_of(F.concat(x["left"], node, x["right"])))


def manifest(
    docs: DataFrame, altered: Mapping[str, Column] | None = None, where: Column | None = None, id_col: str = "doc_id",
    group_col: str = "lang", fields: Sequence[str] = FIELDS, fan: int = FAN, block: int = BLOCK,
) -> DataFrame:
    """(id, leaf, subroot, root, path, folded_root), one row per row of ``docs``.

    Every row is a leaf: the digest of its framed ``fields``. Leaves of one group stand in the
    order of their ids, every ``fan`` neighbours become their digest's digest until one, the
    group's subroot, is left, and the subroots become the root likewise. ``path`` leads from the
    leaf to the root: per level the joined digests left and right of the node. ``folded_root``
    is computed from it and from the row's leaf, in which, ``where`` that holds, the columns of
    ``altered`` are replaced by its expressions; it differs from the root where they differ.

    A group may be null and is then the first; null ids come first; rows of one id stand in the
    order of their leaves. An empty text and a null one differ. Repeated rows are leaves each.
    An empty table gives an empty result. Columns besides id, group and fields are not read.

    Blocks of up to ``block`` leaves climb all their levels in one window partition each, then
    blocks of their tops, so that a group with most of the rows is spread over all tasks and the
    number of rounds is the logarithm of its size to the base ``block``."""
    if fan < 2:
        raise ValueError(f"a run needs at least two nodes, not {fan}")
    touched = F.coalesce(where, F.lit(False)) if where is not None else F.lit(altered is not None)
    leaf = leaf_of(fields)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(group_col).alias("g"), leaf.alias("digest"),
        F.when(touched, leaf_of(fields, altered)).alias("changed"),
    )
    placed = positions(rows, ["g"], ["id", "digest"])
    placed = cut_lineage(placed, "leaves")
    sizes = cut_lineage(placed.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    nodes = skewed_lookup(placed, sizes.withColumn("c", F.col("n")), ["g"], "c", placed.count(), F.col("pos"))
    rounds = climb(nodes, ["g"], fan, block)
    # subroots as leaves of the last tree
    subroots = rounds[-1].where("pos = 0").select("g", F.col("top").alias("digest"))
    subroots = positions(subroots.withColumn("all", F.lit(0)), ["all"], ["g"])
    head = climb(subroots.withColumn("n", F.lit(subroots.count()).cast("bigint")), ["all"], fan, block)
    root = head[-1].where("pos = 0").select("top").first()
    groups = descend(head, ["all"]).select("g", F.col("digest").alias("subroot"), F.col("path").alias("rest"))
    groups = groups.join(sizes.withColumnRenamed("g", "__g"), F.col("g").eqNullSafe(F.col("__g"))).drop("__g")
    # a group's last round goes on with the group's path
    end = rounds[-1].drop("n")
    end = skewed_lookup(end, cut_lineage(groups, "subroots"), ["g"], "n", end.count(), F.col("pos"))
    rounds[-1] = end.withColumn("path", F.concat("path", "rest")).drop("rest")
    found = descend(rounds, ["g"], ["subroot"])
    return found.select(
        F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", F.lit(root and root.top).alias("root"), "path",
        folded(F.coalesce("changed", "digest"), F.col("path")).alias("folded_root"),
    )


def proof_text(path: Column) -> Column:
    """The siblings of a path, from left to right, level by level."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")
