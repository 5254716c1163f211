"""Prefix trie of rebuilt conversations, its subtree totals by time-forward processing."""

from __future__ import annotations

import heapq
import math
import os
import pickle
import tempfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import skewed_lookup, text_of
from evenkeel.llm.order import positions
from evenkeel.session import cut_lineage, scratch_path

#: A conversation starts with up to MOST - 1 turns of the first of its FAMILY.
FAMILY, MOST = 5, 9
#: Key of a prefix: four sums of 40 bits, as hex digits.
LANES, BITS = 4, 40
MASK = (1 << BITS) - 1
ROOT = "0" * (LANES * BITS // 4)
#: Turns of a conversation that one window partition sums up.
STRETCH = 4096
#: A shard's nodes have member counts within a factor of SPREAD and levels of one band, of at
#: least BAND levels and of at most 1/BANDS of all.
SPREAD, BAND, BANDS = 1024, 4096, 64
#: Messages that a queue holds in memory, and ids that one row of a digest's input joins.
IN_MEMORY, JOINED = 200_000, 4096


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes over from the first of its family."""
    return (F.crc32(conv.cast("string").cast("binary")) % MOST).cast("int")


def lanes(digest: Column, at: Column) -> list[Column]:
    return [F.xxhash64(F.lit(i), digest, at.cast("bigint")).bitwiseAND(F.lit(MASK)) for i in range(LANES)]


def prefix_keys(turns: DataFrame) -> DataFrame:
    """``turns`` (c, i, digest, ..), i from 1, with the keys of the prefix that ends with the turn
    and of the one before.

    A prefix is a set of (place, turn), so that its key can be a sum of hashes. Sums run within
    stretches of a conversation; the sums of the stretches before are added, so that no
    conversation is bound to one task."""
    names = [f"__l{i}" for i in range(LANES)]
    rows = turns.withColumn("__s", F.floor((F.col("i") - 1) / STRETCH)).withColumns(dict(zip(names, lanes(F.col("digest"), F.col("i")))))
    parts = rows.groupBy("c", "__s").agg(*[F.sum(n).bitwiseAND(F.lit(MASK)).alias(n) for n in names])
    earlier = Window.partitionBy("c").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(F.col("c").alias("__c"), F.col("__s").alias("__t"), *[F.sum(n).over(earlier).alias(f"__b{i}") for i, n in enumerate(names)])
    before = before.where("__b0 is not null")
    own = Window.partitionBy("c", "__s").orderBy("i")
    rows = rows.select("*", *[F.sum(n).over(own.rowsBetween(Window.unboundedPreceding, 0)).alias(f"__a{i}") for i, n in enumerate(names)])
    rows = rows.join(before, (F.col("c") == F.col("__c")) & (F.col("__s") == F.col("__t")), "left")
    full = [(F.col(f"__a{i}") + F.coalesce(f"__b{i}", F.lit(0))).bitwiseAND(F.lit(MASK)) for i in range(LANES)]
    past = [(x - F.col(n)).bitwiseAND(F.lit(MASK)) for x, n in zip(full, names)]
    text = lambda xs: F.concat(*[F.lpad(F.lower(F.hex(x)), BITS // 4, "0") for x in xs])
    return rows.select(*turns.columns, text(full).alias("key"), text(past).alias("parent"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns (c, i, bytes, digest), sizes (c, length)) of the rebuilt conversations."""
    role, text = text_of(F.col("role").cast("string")), text_of(F.col("text").cast("string"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("c"), "turn", F.md5(said.cast("binary")).alias("digest"), F.octet_length(text).cast("bigint").alias("bytes"),
    )
    rows = positions(rows, ["c"], ["turn", "digest"], "at")
    rows = cut_lineage(rows.withColumn("at", F.col("at") + 1), "ordered-turns")
    own = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    first = own.select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    sizes = own.withColumn("h", shared_turns(F.col("c"))).withColumn("base", F.col("c") - F.col("c") % FAMILY).join(first, "base", "left")
    taken = F.least(F.coalesce("base_n", F.lit(0)), F.col("h"))
    sizes = sizes.select("c", "n", "h", "base", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    sizes = cut_lineage(sizes, "conversation-sizes")
    start = rows.where(F.col("at") < MOST).withColumnRenamed("c", "base")
    heads = start.join(sizes.select("c", "h", "base", "length"), "base").where("at <= h").select("c", F.col("at").alias("i"), "digest", "bytes", "length")
    tails = rows.where(F.col("at") > shared_turns(F.col("c")))
    tails = skewed_lookup(tails, sizes.select("c", "n", "h", "taken", "length"), ["c"], "n", rows.count(), F.col("at"))
    tails = tails.select("c", (F.col("taken") + F.col("at") - F.col("h")).alias("i"), "digest", "bytes", "length")
    return heads.unionByName(tails), sizes


class SpillingQueue:
    """Smallest item first. Beyond ``limit`` items in memory they are written as a sorted run to a
    file of this task's own, in the folder where Spark lets tasks spill, and merged when taken."""

    def __init__(self, limit: int = IN_MEMORY) -> None:
        self.limit, self.heap, self.runs, self.spills = limit, [], [], 0

    def _read(self, file) -> Iterator[tuple]:
        file.seek(0)
        with file:
            while part := pickle.load(file):
                yield from part

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            folders = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")
            file = tempfile.TemporaryFile(dir=folders[0] or None)
            self.heap.sort()
            for at in range(0, len(self.heap), 4096):
                pickle.dump(self.heap[at : at + 4096], file)
            pickle.dump([], file)
            self.heap = []
            run = self._read(file)
            heapq.heappush(self.runs, (next(run), self.spills, run))
            self.spills += 1

    def __bool__(self) -> bool:
        return bool(self.heap or self.runs)

    def first(self) -> tuple:
        return min([x[0] for x in (self.heap, *([self.runs[0]] if self.runs else [])) if x])

    def pop(self) -> tuple:
        if not self.runs or (self.heap and self.heap[0] <= self.runs[0][0]):
            return heapq.heappop(self.heap)
        item, k, run = self.runs[0]
        follow = next(run, None)
        if follow is None:
            heapq.heappop(self.runs)
        else:
            heapq.heapreplace(self.runs, (follow, k, run))
        return item


FIELDS = ("shard", "depth", "key", "parent", "childless", "saved", "more_leaves", "more_saved")
TOTALS = "key string, n_leaves bigint, saved_tokens bigint"


def forward(batches: Iterator[pa.RecordBatch], limit: int = IN_MEMORY) -> Iterator[pa.RecordBatch]:
    """Subtree totals of nodes sorted by shard and reverse level order.

    Each node takes the totals that its children have sent from the queue, adds what came from
    other shards and sends its own on to its parent, which comes later in the order. A shard's
    root sends nothing: its total goes to another shard."""
    queue, shard = SpillingQueue(limit), None
    for batch in batches:
        out: list[list] = [[], [], []]
        for own, depth, key, parent, childless, saved, leaves, extra in zip(*[batch.column(f).to_pylist() for f in FIELDS]):
            if own != shard:
                assert not queue, "a message without its receiver"
                shard = own
            leaves, saved = leaves + childless, saved + extra
            while queue and queue.first()[:2] == (-depth, key):
                _, _, more, words = queue.pop()
                leaves, saved = leaves + more, saved + words
            if key != own:
                queue.push((1 - depth, parent, leaves, saved))
            for column, value in zip(out, (key, leaves, saved)):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["key", "n_leaves", "saved_tokens"])


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """(key, n_leaves, saved_tokens) of ``nodes`` (key, parent, depth, childless, saved, shard, wave,
    parent_wave), stored and laid out by wave.

    The shards of one wave are independent of each other and processed together. The totals of
    their roots are the messages to the shards of later waves. Waves are few: at most BANDS times
    the logarithm of the number of members to the base SPREAD."""
    waves = sorted(r.wave for r in nodes.select("wave").distinct().collect())
    done, sent = [], []
    for wave in waves:
        rows = nodes.where(F.col("wave") == wave)
        if sent:
            mail = reduce(DataFrame.unionByName, sent).where(F.col("to_wave") == wave)
            mail = mail.groupBy(F.col("to").alias("key")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
            rows = rows.join(mail, "key", "left")
        else:
            rows = rows.withColumns({"more_leaves": F.lit(None).cast("bigint"), "more_saved": F.lit(None).cast("bigint")})
        rows = rows.select(*FIELDS[:6], *[F.coalesce(c, F.lit(0)).alias(c) for c in FIELDS[6:]])
        ordered = rows.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "key")
        totals = cut_lineage(ordered.mapInArrow(forward, TOTALS), "subtree-totals")
        done.append(totals)
        roots = nodes.where((F.col("wave") == wave) & (F.col("key") == F.col("shard"))).select("key", F.col("parent").alias("to"), F.col("parent_wave").alias("to_wave"))
        sent.append(cut_lineage(totals.join(roots, "key").drop("key"), "roots-totals"))
    return reduce(DataFrame.unionByName, done) if done else nodes.sparkSession.createDataFrame([], TOTALS)


def id_digests(ids: DataFrame) -> DataFrame:
    """(key, digest) of ``ids`` (key, c): SHA-256 of each key's ids in ascending order, comma-joined.

    Ids are joined in rows of JOINED by tasks. A key of one such row is hashed there; the rows
    of others pass through a hash in order, one at a time."""
    placed = positions(ids, ["key"], ["c"])
    parts = placed.groupBy("key", F.floor(F.col("pos") / JOINED).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("text"), F.max("pos").alias("last"))
    parts = cut_lineage(parts, "joined-ids")
    long = parts.where("part > 0").select("key").distinct()
    short = parts.join(long, "key", "left_anti").select("key", F.sha2("text", 256).alias("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        key, state = None, None
        for batch in batches:
            done = []
            for k, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                if k == key:
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in (0, 1)], names=["key", "digest"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (key, state.hexdigest())], names=["key", "digest"])

    ordered = parts.join(long, "key", "left_semi").repartition("key").sortWithinPartitions("key", "part").select("key", "text")
    return short.unionByName(ordered.mapInArrow(run, "key string, digest string"))


def prefix_trie(conversations: DataFrame, spread: int = SPREAD, band: int = BAND) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one
    row per distinct start of rebuilt conversations (conv_id, turn, role, text).

    A node is a sequence of (role, text), from the root without turns; its members are the rebuilt
    conversations that start with it, named by the smallest. Turns of equal number stand in the
    order of their digests. Null and empty roles or texts are alike. Rows without a conv_id are in
    no conversation. An empty table gives an empty result. Other columns are not read.

    Totals over subtrees are found by time-forward processing. A shard is a connected part of the
    trie whose member counts lie within one power of ``spread`` and whose depths lie in one band
    of ``band`` levels or more. As its root has less than ``spread`` times the members of each of
    its nodes, a level of it has at most ``spread`` nodes, however many
    conversations share a start."""
    turns, sizes = rebuilt(conversations)
    rows = cut_lineage(prefix_keys(turns.withColumn("i", F.col("i").cast("bigint"))), "prefixes")
    rows = rows.select("c", F.col("i").alias("depth"), "key", "parent", "bytes", "length")
    top = sizes.select("c", F.lit(0).cast("bigint").alias("depth"), F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("bytes"), "length")
    rows = rows.unionByName(top)
    nodes = rows.groupBy("key").agg(
        F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("depth").alias("depth"),
        F.first("bytes").alias("bytes"), F.first("parent").alias("parent"),
    )
    nodes = cut_lineage(nodes, "nodes")
    about = nodes.agg(F.max("depth").alias("deepest"), F.count(F.lit(1)).alias("n"), F.max("n_convs").alias("most"), F.sum("n_convs").alias("rows")).first()
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes-children")
    levels = max(band, -(-((about.deepest or 0) + 1) // BANDS))
    classes = 1 + math.ceil(math.log(max(2, about.most or 0), spread))
    # waves ascend from small and deep shards to large and shallow ones
    size = F.least(F.floor(F.log(F.col("n_convs").cast("double")) / math.log(spread)), F.lit(classes - 1))
    wave = ((F.floor(F.lit(about.deepest or 0) / levels) - F.floor(F.col("depth") / levels)) * classes + size).cast("int")
    nodes = nodes.withColumn("wave", wave)
    up = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("wave").alias("parent_wave"), F.col("n_children").alias("n"))
    nodes = skewed_lookup(nodes, cut_lineage(up, "parents"), ["parent"], "n", about.n, F.col("key"))
    nodes = cut_lineage(nodes, "nodes-parents")
    # a node's shard is named by the first node of its wave on the way to it
    known = nodes.select("key", "wave", F.col("conv_id").alias("named"), F.col("n_convs").alias("n"))
    path = skewed_lookup(rows.select("c", "depth", "key"), known, ["key"], "n", about.rows or 0, F.col("c"))
    first = F.first("key").over(Window.partitionBy("c", "wave").orderBy("depth"))
    shards = path.withColumn("shard", first).where("c = named").select("key", "shard")
    own = nodes.select("key", "parent", "depth", "wave", "parent_wave", (F.col("n_children") == 0).cast("bigint").alias("childless"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    where = scratch_path(conversations.sparkSession, "sharded-nodes")
    own.join(shards, "key").write.partitionBy("wave").parquet(where)
    totals = subtree_totals(conversations.sparkSession.read.schema(own.schema.add("shard", "string")).parquet(where))
    ends = id_digests(rows.where("depth = length").select("key", "c"))
    out = nodes.join(totals, "key").join(ends, "key", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
