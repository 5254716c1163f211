"""Near-duplicate documents: one-permutation MinHash with optimal densification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import skewed_lookup
from evenkeel.llm.stars import in_shared_buckets, link
from evenkeel.operators.sizing import broadcast_if_small
from evenkeel.session import cut_lineage

SHINGLE = 5
SIMILARITY = 80
#: 73 bands of 7 bins: a pair at similarity 0.8 shares no bucket with a chance of 4e-8.
BIN_BITS = 9
BAND_BINS = 7
#: Smaller sets are not held to the sketch test: few values fill all bins, so that the number of
#: bins apart varies more.
LEAST_SKETCHED = 64
#: Words of a map in which a set's shingles are bits; a power of two.
MAP_WORDS = 4
#: Shingles of more sets than this come last in the order of rarity, by their number of sets.
OFTEN = 16

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class Powers:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", np.uint64(_inverse(int(_BASE))))):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word of one text in UTF-8, A-Z taken as a-z."""
    gap = _SPACE[data]
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    n = len(data)
    Powers.reach(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * Powers.up[:n], out=sums[1:])
    return mixed((sums[end] - sums[start]) * Powers.down[start] + (end - start).astype(np.uint64))


def shingle_set(data: np.ndarray, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``shingle`` words; of all its words
    where it has fewer; none without words."""
    words = word_hashes(data)
    n = min(shingle, len(words))
    if not n:
        return words
    at = len(words) - n + 1
    total = words[:at] * _STEP[0]
    for i in range(1, n):
        total = total + words[i : i + at] * _STEP[i]
    return np.unique(mixed(total + np.uint64(n)))


class Signatures:
    """One-permutation hashing: the hash's first bits choose the bin, its least value counts.

    Densification is optimal: each empty bin has an order of its own over all bins, and takes
    the value of the first non-empty one there, so that two sets agree in it with the
    probability of their similarity."""

    def __init__(self, bits: int = BIN_BITS, rows: int = BAND_BINS) -> None:
        self.bins, self.shift, self.rows = 1 << bits, np.uint64(64 - bits), rows
        rng = np.random.default_rng(20240301)
        self.order = np.argsort(rng.random((self.bins, self.bins)), axis=1).astype(np.uint16)
        self.bands = self.bins // rows
        self.scale = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = mixed(np.arange(1, self.bands + 1, dtype=np.uint64))
        # bins that borrow one value have bits of their own
        self.bin_salt = rng.integers(0, 1 << 64, self.bins, dtype=np.uint64)

    def values(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> self.shift).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        full = at[first]
        out = np.zeros(self.bins, dtype=np.uint64)
        out[full] = hashes[first]
        if len(full) < self.bins:
            empty = np.ones(self.bins, dtype=bool)
            empty[full] = False
            empty = np.flatnonzero(empty)
            out[empty] = out[full[self.order[np.ix_(empty, full)].argmin(axis=1)]]
        return out

    def buckets(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket of each band, sketch of one bit per bin in 64-bit words)."""
        values = self.values(hashes)
        sketch = np.packbits((mixed(values ^ self.bin_salt) >> np.uint64(63)).astype(np.uint8)).view(np.int64)
        values = mixed(values)
        bands = values[: self.bands * self.rows].reshape(self.bands, self.rows)
        return mixed((bands * self.scale).sum(axis=1, dtype=np.uint64) + self.salt).view(np.int64), sketch


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    for text in column:
        yield np.frombuffer(text.as_buffer(), dtype=np.uint8) if text.is_valid else np.zeros(0, dtype=np.uint8)


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, n_shingles, digest of the set, bucket of each band, sketch) per row of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signatures()
        for batch in batches:
            sizes, digests, buckets, sketches = [], [], [], []
            for data in _texts(batch.column("text")):
                found = shingle_set(data, shingle)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                bands, sketch = sign.buckets(found) if len(found) else (None, None)
                buckets.append(bands)
                sketches.append(sketch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(buckets, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                names=["id", "n_shingles", "digest", "buckets", "sketch"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n_shingles bigint, digest binary, buckets array<bigint>, sketch array<bigint>")


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, set) per row of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, shingle).view(np.int64) for t in _texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, set array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach ``similarity`` percent."""
    for end in ("a", "b"):
        side = sets.select(F.col("id").alias(end), F.col("set").alias(f"set_{end}"))
        pairs = pairs.join(side, end)
    both = F.size(F.array_intersect("set_a", "set_b")).cast("bigint")
    sized = pairs.select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).cast("bigint").alias("sum"))
    return sized.where(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * similarity).select("a", "b")


def bitmap(hashes: Column) -> list[Column]:
    """MAP_WORDS words of 64 bits in which each hash of an array sets one bit."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(F.lit(63)).cast("int"))
    of = lambda k: F.filter(hashes, lambda x: F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(MAP_WORDS - 1)) == k)
    return [F.aggregate(of(k), F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(bit(x))).alias(f"m{k}") for k in range(MAP_WORDS)]


def exact_links(apart: DataFrame, others: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """All linked pairs (a, b) of an id of ``apart`` (id, main) and one of ``others`` (id, main,
    pivot) of the same main, or a chain of links that connects them; ``others`` holds those of
    ``apart`` too, and a main has one pivot.

    Sets are compared by what sets them apart from their pivot P. Where x lacks r of P's shingles
    and has a others, and D(x) holds both, two sets share |P| - r(x) - r(y) + |D(x) & D(y)|
    shingles. With s = similarity / (100 + similarity) and w = s * a + (1 - s) * r they are linked
    if |D(x) & D(y)| >= w(x) + w(y) - (1 - 2 * s) * |P|. For the pivot itself w is 0 and D empty, so
    that x is linked to it if w(x) <= (1 - 2 * s) * |P|. Any other x must share more than w(y) shingles
    of D(y) with each y that it is linked to, and is held against those by a prefix-filter join:
    sorted by rarity, the first shingle that both share is one of the first |D| - t + 1 of each, if
    they must share t. What a whole group has in common so makes no pairs. A bit that only one map of
    the two has is a shingle that they do not share, and rules out most others."""
    scale = 100 + similarity
    theirs = cut_lineage(others.join(sets, "id"), "apart-sets")
    pivots = sets.join(others.select(F.col("pivot").alias("id")).distinct(), "id", "left_semi")
    pivots = cut_lineage(pivots.select(F.col("id").alias("pivot"), F.col("set").alias("p")), "pivot-sets")
    lack, more = F.array_except("p", "set"), F.array_except("set", "p")
    rest = theirs.join(pivots, "pivot").select(
        "main", "id", "pivot", F.concat(lack, more).alias("d"), (F.size(more) * similarity + F.size(lack) * 100).cast("bigint").alias("w"),
        (F.size("p") * (100 - similarity)).cast("bigint").alias("room"),
    )
    rest = cut_lineage(rest.join(apart.withColumn("asks", F.lit(True)), ["main", "id"], "left"), "residuals")
    near = rest.where("w <= room and id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
    asking = rest.where("asks and w > room")
    rest = rest.join(cut_lineage(asking.select("main").distinct(), "open-mains"), "main", "left_semi")
    maps = [f"m{k}" for k in range(MAP_WORDS)]
    each = rest.select("main", "id", "w", "room", F.coalesce("asks", F.lit(False)).alias("asks"), F.size("d").alias("n"), F.explode("d").alias("s"))
    often = each.groupBy("main", "s").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > OFTEN)
    ranked = each.join(broadcast_if_small(cut_lineage(often, "frequent-shingles")), ["main", "s"], "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "s")))
    ranked = ranked.groupBy("main", "id", "w", "room", "asks", "n").agg(order.alias("order"))
    # places up to which the first common shingle may stand: as one of ``others``, and as one of ``apart``
    there, here = F.col("n") - F.floor(F.col("w") / scale), F.col("n") - F.ceil((F.col("w") - F.col("room")) / scale) + 1
    ranked = ranked.withColumn("there", there).withColumn("here", F.when(F.col("asks") & (F.col("w") > F.col("room")), here).otherwise(0))
    first = F.slice("order", 1, F.greatest("there", "here").cast("int"))
    prefix = ranked.select("main", "id", "w", "room", "n", "there", "here", F.posexplode(first).alias("at", "x"))
    prefix = prefix.withColumn("s", F.col("x.s")).drop("x").join(rest.select("main", "id", *bitmap(F.col("d"))), ["main", "id"])
    prefix = cut_lineage(prefix, "prefixes")
    side = lambda rows, k: rows.select(*[F.col(c).alias(f"{c}_{k}") for c in ("main", "s", "id", "w", "room", "n", "at", *maps)])
    common = F.col("w_x") + F.col("w_y") - F.col("room_x")
    left = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    both = [F.col("main_x") == F.col("main_y"), F.col("s_x") == F.col("s_y"), F.col("id_x") != F.col("id_y"), left * scale >= common]
    for k, other in (("x", "y"), ("y", "x")):
        own = sum((F.bit_count(F.col(f"{m}_{k}").bitwiseAND(F.bitwise_not(f"{m}_{other}"))) for m in maps), F.lit(0))
        both.append((F.col(f"n_{k}") - own) * scale >= common)
    met = side(prefix.where("at < here"), "x").join(side(prefix.where("at < there"), "y"), both)
    met = cut_lineage(met.select(F.col("main_x").alias("main"), F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct(), "pairs")
    for end in ("a", "b"):
        held = rest.select("main", F.col("id").alias(end), F.col("d").alias(f"d_{end}"), F.col("w").alias(f"w_{end}"), F.col("room").alias(f"room_{end}"))
        met = met.join(held, ["main", end])
    shared = F.size(F.array_intersect("d_a", "d_b")) * scale
    return near.unionAll(met.where(shared >= F.col("w_a") + F.col("w_b") - F.col("room_a")).select("a", "b"))


def possible(similarity: int, bins: int):
    """Can two marks (n, w0 .. w7) reach the similarity?

    Their sizes must allow it, and of the one-bit sketches' bits about (1 + similarity) / 2 must
    agree. The bound is 6.5 standard deviations below, so that a pair at the similarity fails
    with a chance below 1e-9, less than that of sharing no bucket. Where one has less than
    LEAST_SKETCHED shingles only the sizes count."""
    agree = (1 + similarity / 100) / 2
    least = math.ceil(bins * agree - 6.5 * math.sqrt(bins * agree * (1 - agree)))

    def test(a: Column, b: Column) -> Column:
        sizes = F.least(a["n"], b["n"]) * 100 >= F.greatest(a["n"], b["n"]) * similarity
        apart = sum((F.bit_count(a[f"w{i}"].bitwiseXOR(b[f"w{i}"])) for i in range(bins // 64)), F.lit(0))
        return sizes & ((F.least(a["n"], b["n"]) < LEAST_SKETCHED) | (apart <= bins - least))

    return test


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle: int = SHINGLE, similarity: int = SIMILARITY,
) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per row of ``docs``.

    A document's set holds its distinct shingles of ``shingle`` words in lower case (A-Z), or
    all its words as one where it has fewer; documents are linked from a Jaccard similarity of
    ``similarity`` percent, and component_id is the smallest id that links reach. Equal sets
    are one vertex. Candidates share one of 73 buckets of a 512-bin signature and are compared
    on the full sets of 64-bit hashes.

    A document without words has no links and stays. So does a row without id, whose component
    is null. Rows of one id are one document. An empty table gives an empty result. Other
    columns are not read."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = cut_lineage(fingerprints(rows, shingle), "fingerprints")
    linkable = marks.where("id is not null and n_shingles > 0")
    sets = linkable.groupBy("digest").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("c"), F.first("n_shingles").alias("n"),
        F.first("buckets").alias("buckets"), F.first("sketch").alias("sketch"),
    )
    sets = cut_lineage(sets, "distinct-sets")
    dealt = sets.select(F.col("rep").alias("id"), F.explode("buckets").alias("bucket"))
    sign = Signatures()
    words = [F.element_at("sketch", i + 1).alias(f"w{i}") for i in range(sign.bins // 64)]
    marks_of = sets.select(F.col("rep").alias("id"), F.struct("n", *words).alias("mark"))
    members = in_shared_buckets(dealt, sets.count() * sign.bands, marks_of)
    wanted = members.select("id").distinct()
    candidates = full_sets(rows.join(wanted, "id", "left_semi"), shingle).where("size(set) > 0")
    candidates = cut_lineage(candidates.dropDuplicates(["id"]), "full-sets")
    labels = link(
        members, possible(similarity, sign.bins), lambda pairs: confirmed(pairs, candidates, similarity),
        lambda apart, others: exact_links(apart, others, candidates, similarity),
    )
    least = labels.groupBy("root").agg(F.min("v").alias("component_id"))
    labels = labels.join(least, "root").select(F.col("v").alias("rep"), "component_id")
    found = sets.select("digest", "rep", "c").join(labels, "rep", "left")
    found = cut_lineage(found.select("digest", "c", F.coalesce("component_id", "rep").alias("component_id")), "components-of-sets")
    out = skewed_lookup(marks.drop("buckets", "sketch"), found, ["digest"], "c", marks.count(), F.col("id"))
    own = F.when(F.col("id").isNull() | (F.col("n_shingles") == 0), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("id")).alias("kept")
    )
