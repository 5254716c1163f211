"""Shards of near-equal size that keep groups of rows together: best-fit-decreasing packing."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import running_total, skewed_lookup, text_of
from evenkeel.operators.sizing import broadcast_if_small
from evenkeel.session import cut_lineage

#: Groups below 1/GRAINS of a shard are first packed into bundles of that size, in parallel.
GRAINS = 256
GROUPS_PER_TASK = 10_000
SLOTS_PER_TASK = 50_000
#: As many shards are packed together by one task.
SHARDS_TOGETHER = 1024


class Bins:
    """Open bins ordered by remaining capacity: a treap, balanced by hashed priorities."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right], key = (remaining, bin)

    def _split(self, node: list | None, key: tuple) -> tuple[list | None, list | None]:
        """Trees of the keys below ``key``, and of the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, key: tuple[int, int]) -> None:
        left, right = self._split(self.root, key)
        node = [key, (key[1] * 2654435761 + key[0] * 40503) % 4294967291, None, None]
        self.root = self._merge(self._merge(left, node), right)

    def _take(self, node: list | None, end: int) -> tuple[tuple | None, list | None]:
        """The smallest (end 2) or largest (3) key, and the tree without it."""
        if node is None:
            return None, None
        if node[end] is None:
            return node[0], node[5 - end]
        key, node[end] = self._take(node[end], end)
        return key, node

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the bin with the least remaining capacity of at least ``size``."""
        left, right = self._split(self.root, (size, -1))
        key, right = self._take(right, 2)
        self.root = self._merge(left, right)
        return key

    def widest(self) -> tuple[int, int] | None:
        key, self.root = self._take(self.root, 3)
        return key


def best_fit_decreasing(sizes: Iterable[int], capacity: int, bins: int | None = None) -> list[int]:
    """Bin number per size, given in decreasing order.

    Each item enters the tightest bin it fits. What fits nowhere opens a new bin or, with a
    fixed number of ``bins``, enters the emptiest one."""
    tree, opened, out = Bins(), 0, []
    for b in range(bins or 0):
        tree.add((capacity, b))
    for size in sizes:
        key = tree.tightest(size)
        if key is None and bins:
            key = tree.widest()
        if key is None:
            key, opened = (max(capacity, size), opened), opened + 1
        tree.add((key[0] - size, key[1]))
        out.append(key[1])
    return out


def bundles_of(capacity: int):
    def pack(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["size", "digest"], ascending=[False, True], kind="stable")
        return groups.assign(bundle=best_fit_decreasing(groups["size"].tolist(), capacity)).astype({"bundle": "int32"})

    return pack


def shards_of(limit: int, shards: int | None, ranges: int):
    """Best fit of the units of one range. With a fixed number of shards, range r has those from
    r * shards / ranges on; otherwise a range numbers its shards from 0."""

    def pack(units: pd.DataFrame) -> pd.DataFrame:
        near = int(units["near"].iloc[0])
        begin, end = (0, None) if shards is None else (near * shards // ranges, (near + 1) * shards // ranges)
        order = units.assign(name=units["lone"].map(lambda d: "" if d is None else bytes(d).hex()))
        units = units.loc[order.sort_values(["size", "task", "bundle", "name"], ascending=[False, True, True, True], kind="stable").index]
        found = best_fit_decreasing([int(s) for s in units["size"]], limit, None if end is None else end - begin)
        return pd.DataFrame({
            "near": near, "u_task": units["task"].astype("Int32"), "u_bundle": units["bundle"].astype("Int32"),
            "u_lone": units["lone"], "shard": pd.Series(found, index=units.index, dtype="int32") + begin,
        })

    return pack


def pack_groups(groups: DataFrame, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """Add ``shard`` to ``groups`` (digest binary, size, n), a stored table.

    Either ``shards`` of near-equal size, or as few as best-fit-decreasing finds of at most
    ``capacity`` (a group above it has a shard to itself).

    Groups of a grain (1/GRAINS of a shard) or more are few: at most GRAINS for each shard.
    Smaller ones are dealt by digest to tasks that pack them into bundles of one grain, all but
    one of a task over half full. Those large groups and bundles are then dealt to ranges of
    SHARDS_TOGETHER shards by hash, and one task packs each range; beyond one range, the sums of
    ranges of a quarter million units differ by about 0.2 %. All counts follow from the table
    alone, so that the same rows land in the same shards on any cluster."""
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    row = groups.agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n")).first()
    total = int(row.total or 0)
    limit = capacity if capacity is not None else max(1, -(-total // shards))
    grain = max(1, limit // GRAINS)
    tasks = max(1, -(-row.n // GROUPS_PER_TASK))
    large = groups.where(F.col("size") >= grain).select("digest", F.lit(None).cast("int").alias("task"), F.lit(None).cast("int").alias("bundle"), "size", "n")
    small = groups.where(F.col("size") < grain).withColumn(
        "task", F.pmod(F.xxhash64("digest"), F.lit(tasks)).cast("int")
    )
    schema = "digest binary, size bigint, n bigint, task int, bundle int"
    bundled = small.select("digest", "size", "n", "task").groupBy("task").applyInPandas(bundles_of(grain), schema)
    placed = cut_lineage(bundled.select("digest", "task", "bundle", "size", "n").unionByName(large), "bundles")
    # one row per large group or bundle; those of bundles have no digest
    lone = F.when(F.col("bundle").isNull(), F.col("digest")).alias("lone")
    count = shards or max(1, -(-total // limit))
    ranges = -(-count // SHARDS_TOGETHER)
    near = F.pmod(F.xxhash64("task", "bundle", "lone"), F.lit(ranges)).cast("int")
    units = placed.groupBy("task", "bundle", lone).agg(F.sum("size").alias("size")).withColumn("near", near)
    schema = "near int, u_task int, u_bundle int, u_lone binary, shard int"
    shard_of = cut_lineage(units.groupBy("near").applyInPandas(shards_of(limit, shards, ranges), schema), "shards-of-units")
    if shards is None:
        opened = shard_of.groupBy("near").agg((F.max("shard") + 1).alias("opened"))
        first = running_total(opened, "opened", ["near"], "first").select("near", F.col("first").cast("int").alias("first"))
        shard_of = shard_of.join(first, "near").withColumn("shard", F.col("shard") + F.col("first"))
    shard_of = broadcast_if_small(shard_of.drop("near"))
    on = [
        F.col("task").eqNullSafe(F.col("u_task")), F.col("bundle").eqNullSafe(F.col("u_bundle")),
        F.when(F.col("bundle").isNull(), F.col("digest")).eqNullSafe(F.col("u_lone")),
    ]
    return placed.join(shard_of, on, "left").select("digest", "n", "shard")


def shard_units(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shards: int | None = None, capacity: int | None = None,
) -> DataFrame:
    """(id, digest, size, text_crc32, copies, shard, start), one row per distinct id and text.

    Its ``copies`` rows have the slots from ``start`` on. Slots are numbered by buckets of the
    id's hash, each shifted by the sizes of those before in its shard: no task numbers a whole
    shard, however many rows its groups have."""
    text = text_of(F.col("t"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).select(
        "id", (F.coalesce(F.octet_length("t"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), text_digest(F.col("t")).alias("digest"),
    )
    rows = rows.groupBy("id", "size", "text_crc32", "digest").agg(F.count(F.lit(1)).alias("copies"))
    rows = cut_lineage(rows, "sized")
    mass = F.sum(F.col("size") * F.col("copies")).alias("size")
    groups = cut_lineage(rows.groupBy("digest").agg(mass, F.count(F.lit(1)).alias("n")), "groups")
    placed = cut_lineage(pack_groups(groups, shards, capacity), "shards-of-groups")
    total = rows.count()
    out = skewed_lookup(rows, placed, ["digest"], "n", total, F.col("id"))
    buckets = max(1, -(-total // SLOTS_PER_TASK))
    out = cut_lineage(out.withColumn("b", F.pmod(F.xxhash64("id", "digest"), F.lit(buckets)).cast("int")), "sharded")
    sizes = out.groupBy("shard", "b").agg(F.sum("copies").alias("c"))
    w = Window.partitionBy("shard").orderBy("b")
    before = sizes.select("shard", "b", (F.sum("c").over(w) - F.col("c")).alias("before"))
    ordered = Window.partitionBy("shard", "b").orderBy("id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("copies").over(ordered), F.lit(0))
    return (
        out.withColumn("in", within).join(before, ["shard", "b"])
        .withColumn("start", (F.col("before") + F.col("in")).cast("bigint"))
        .select("id", "digest", "size", "text_crc32", "copies", "shard", "start")
    )


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text_of(text).cast("binary"), 256))


def shard_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shards: int | None = None, capacity: int | None = None,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot), one row per row of ``docs``.

    Size is the text's UTF-8 bytes plus 1 (null: 1). Rows of equal texts, a null one being an
    empty one, share a shard; slots count from 0 in each shard without gaps. Repeated rows
    each have a slot. An empty table gives an empty result. Other columns are not read."""
    units = shard_units(docs, id_col, text_col, shards, capacity)
    each = units.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    return each.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("start") + F.col("i")).alias("slot"))


def place_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shards: int | None = None, capacity: int | None = None,
) -> DataFrame:
    """``docs`` with two more columns, shard and slot, as :func:`shard_rows` gives them. They
    replace columns of these names."""
    units = shard_units(docs, id_col, text_col, shards, capacity)
    units = units.select(F.col("id").alias("__id"), F.col("digest").alias("__d"), F.col("shard").alias("__shard"), F.col("start").alias("__start"))
    keyed = docs.withColumn("__digest", text_digest(F.col(text_col)))
    same = [F.col(id_col).eqNullSafe(F.col("__id")), F.col("__digest") == F.col("__d")]
    kept = [F.col(c) for c in docs.columns if c not in ("shard", "slot")]
    copy = F.row_number().over(Window.partitionBy("__id", "__d").orderBy("__start")) - 1
    return keyed.join(units, same).select(
        *kept, F.col("__shard").alias("shard"), (F.col("__start") + copy).cast("bigint").alias("slot")
    )
