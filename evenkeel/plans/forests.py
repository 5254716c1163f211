"""Random forests over binned rows.

A tree that splits at BINS - 1 thresholds per input cannot tell rows apart that fall between the same
thresholds. Those rows are summed first, each with its own weight in each tree's bootstrap, and
trees are grown from the sums: the rows are read three times, whatever the depth and the number of trees."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.session import cut_lineage

#: Bins of one input, and cells of bins that occur, at most; Spark's own forest takes more cells or inputs.
BINS, CELLS, INPUTS = 32, 20_000, 64
#: Bytes of sums that a task holds.
TASK_BYTES = 64 << 20


def thresholds(rows: DataFrame, indicators: int, width: int) -> list[np.ndarray]:
    """Where each input of ``rows`` (x array) may be split: quantiles, or between all values where
    there are few. The first ``indicators`` inputs are 0 or 1."""
    numbers = range(indicators, width)
    found = {i: np.array([0.5]) for i in range(indicators)}
    if numbers:
        value = {i: F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]) for i in numbers}
        shares = [i / BINS for i in range(1, BINS)]
        row = rows.agg(*[F.percentile_approx(v, shares, 10_000).alias(f"q{i}") for i, v in value.items()], *[F.approx_count_distinct(v).alias(f"d{i}") for i, v in value.items()]).first()
        few = [i for i in numbers if row[f"d{i}"] <= BINS]
        all_ = rows.agg(*[F.array_sort(F.collect_set(value[i])).alias(f"v{i}") for i in few]).first() if few else None
        for i in numbers:
            v = np.array(all_[f"v{i}"] if i in few else [])
            found[i] = (v[1:] + v[:-1]) / 2 if 0 < len(v) <= BINS else np.unique(np.array(row[f"q{i}"] or [], dtype=float))
    return [found[i] for i in range(width)]


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """The bin of every number: the thresholds below it."""
    return np.stack([np.searchsorted(e, x[:, i]).astype(np.uint8) for i, e in enumerate(edges)], axis=1)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), width)


def grouped(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows as bytes, which of them each row is)."""
    return np.unique(np.ascontiguousarray(bins).view(f"V{bins.shape[1]}").reshape(-1), return_inverse=True)


def cell_counts(rows: DataFrame, edges: Sequence[np.ndarray], classes: int) -> DataFrame:
    """(cell, v): rows of each class per cell of bins; without classes their number alone."""
    wide = max(classes, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(int) if classes else 0
            cells, own = grouped(binned(matrix(batch.column("x"), len(edges)), edges))
            n = np.bincount(own * wide + y, minlength=len(cells) * wide).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in cells], pa.binary()), *[pa.array(n[k::wide]) for k in range(wide)]], names=names)

    names = ["cell", *[f"n{k}" for k in range(wide)]]
    parts = rows.mapInArrow(run, "cell binary" + "".join(f", {n} double" for n in names[1:]))
    summed = parts.groupBy("cell").agg(*[F.sum(n).alias(n) for n in names[1:]])
    return summed.select("cell", F.array(*names[1:]).alias("v"))


def bagged_sums(rows: DataFrame, edges: Sequence[np.ndarray], trees: int, centre: float, seed: int) -> DataFrame:
    """(tree, cell, v): weight, weighted sum and sum of squares of y - centre per tree and cell, under a
    Poisson(1) weight of every row in every tree."""
    most = max(1, TASK_BYTES // (24 * trees))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        at: dict[bytes, int] = {}
        sums = np.zeros((256, trees, 3))

        def close() -> Iterator[pa.RecordBatch]:
            keys = list(at)
            for a in range(0, len(keys), 256):
                v = sums[a : min(a + 256, len(keys))]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * trees * 3, pa.int32()), pa.array(v.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 256], pa.binary()), flat], names=["cell", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column("y").to_numpy(zero_copy_only=False) - centre
            cells, own = grouped(binned(matrix(batch.column("x"), len(edges)), edges))
            order = np.argsort(own, kind="stable")
            start = np.searchsorted(own[order], np.arange(len(cells)))
            w, y = rng.poisson(1.0, (len(y), trees)).astype(float), y[order, None]
            if len(at) + len(cells) > most:
                yield from close()
                at.clear()
                sums[:] = 0.0
            places = np.array([at.setdefault(c.tobytes(), len(at)) for c in cells])
            if len(at) > len(sums):
                sums = np.concatenate([sums, np.zeros((max(len(sums), len(at) - len(sums)), trees, 3))])
            for k in range(3):
                sums[places, :, k] += np.add.reduceat(w, start, axis=0)
                w *= y
        yield from close()

    parts = rows.mapInArrow(run, "cell binary, v array<double>").select("cell", array_to_vector("v").alias("v"))
    summed = parts.groupBy("cell").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("v"))
    each = summed.select("cell", "v", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    return each.select("tree", "cell", F.slice("v", F.col("tree") * 3 + 1, 3).alias("v"))


def spread(s: np.ndarray, regression: bool) -> np.ndarray:
    """Weight times impurity (variance or Gini) of sums ``s`` (.., sums)."""
    if regression:
        return s[..., 2] - s[..., 1] ** 2 / np.maximum(s[..., 0], 1e-300)
    n = s.sum(axis=-1)
    return n - (s**2).sum(axis=-1) / np.maximum(n, 1e-300)


def grow(bins: np.ndarray, s: np.ndarray, depth: int, regression: bool, tried: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """One tree as arrays: input (-1 in a leaf), last bin of the left side, left child (the right one
    is next to it) and sums of every node. Of each node's inputs a random ``tried`` are compared."""
    weight = s[:, 0] if regression else s.sum(axis=1)
    bins, s = bins[weight > 0], s[weight > 0]
    node = np.zeros(len(s), dtype=np.int64)
    inputs, cuts, lefts, sums = [], [], [], []
    width, made, level = bins.shape[1], 1, [s.sum(axis=0)]
    for at in range(depth + 1):
        own = np.array(level)
        k = len(own)
        sums.append(own)
        best, which, cut = np.full(k, np.inf), np.full(k, -1), np.zeros(k, dtype=int)
        pure = spread(own, regression) <= 1e-12 * np.maximum(np.abs(own).max(axis=1), 1.0)
        if at < depth:
            mine = rng.random((k, width)).argsort(axis=1)[:, :tried]
            allowed = np.zeros((k, width), dtype=bool)
            np.put_along_axis(allowed, mine, True, axis=1)
            allowed[pure] = False
            for f in range(width):
                some = np.flatnonzero(allowed[:, f])
                if not len(some):
                    continue
                rank = np.full(k, -1)
                rank[some] = np.arange(len(some))
                here = np.flatnonzero(rank[node] >= 0)
                spot = rank[node[here]] * BINS + bins[here, f]
                left = np.stack([np.bincount(spot, s[here, j], len(some) * BINS).reshape(-1, BINS) for j in range(s.shape[1])], axis=-1).cumsum(axis=1)[:, :-1]
                right = own[some, None] - left
                n = (left[..., 0], right[..., 0]) if regression else (left.sum(axis=-1), right.sum(axis=-1))
                cost = np.where((n[0] > 0.5) & (n[1] > 0.5), spread(left, regression) + spread(right, regression), np.inf)
                to = cost.argmin(axis=1)
                least = cost[np.arange(len(some)), to]
                won = least < best[some]
                best[some[won]], which[some[won]], cut[some[won]] = least[won], f, to[won]
        split = best < spread(own, regression) * (1 - 1e-12)
        which = np.where(split, which, -1)
        child = np.where(split, made + 2 * (np.cumsum(split) - 1), -1)
        inputs.append(which), cuts.append(cut), lefts.append(child)
        if not split.any():
            break
        kept = split[node]
        bins, s, node = bins[kept], s[kept], node[kept]
        node = child[node] - made + (bins[np.arange(len(s)), which[node]] > cut[node])
        level = np.stack([np.bincount(node, s[:, j], 2 * int(split.sum())) for j in range(s.shape[1])], axis=1)
        made += len(level)
    return {"input": np.concatenate(inputs), "cut": np.concatenate(cuts), "left": np.concatenate(lefts), "sums": np.concatenate(sums)}


@dataclass(frozen=True)
class BinnedForest:
    """Trees over bins; a row gets the mean of its leaves' class shares or values."""

    edges: Sequence[np.ndarray]
    trees: Sequence[dict[str, np.ndarray]]
    regression: bool

    def scores(self, bins: np.ndarray) -> np.ndarray:
        total = 0.0
        for t in self.trees:
            at = np.zeros(len(bins), dtype=np.int64)
            while len(inner := np.flatnonzero(t["input"][at] >= 0)):
                here = at[inner]
                at[inner] = t["left"][here] + (bins[inner, t["input"][here]] > t["cut"][here])
            total = total + t["leaf"][at]
        return total / len(self.trees)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` (features) with ``prediction`` and, of classes, ``probability``. A task scores each cell once."""

        @F.arrow_udf("array<double>")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known: dict[bytes, np.ndarray] = {}
            for column in batches:
                bins = binned(matrix(column, len(self.edges)), self.edges)
                cells, own = grouped(bins)
                keys = [c.tobytes() for c in cells]
                if len(known) > 10 * CELLS:
                    known.clear()
                if fresh := [c for c in keys if c not in known]:
                    new = np.frombuffer(b"".join(fresh), dtype=np.uint8).reshape(len(fresh), -1)
                    known.update(zip(fresh, self.scores(new)))
                out = np.array([known[c] for c in keys]).reshape(len(keys), -1)[own] if keys else np.zeros((0, 1))
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.reshape(-1)))

        scored = df.withColumn("__s", score(vector_to_array("features")))
        if self.regression:
            return scored.withColumn("prediction", F.col("__s")[0]).drop("__s")
        largest = (F.array_position("__s", F.array_max("__s")) - 1).cast("double")
        return scored.withColumn("probability", array_to_vector("__s")).withColumn("prediction", largest).drop("__s")


def fit_forest(rows: DataFrame, indicators: int, width: int, classes: int, trees: int, depth: int, seed: int) -> BinnedForest | None:
    """A forest of ``rows`` (features, __y) in the manner of Spark's: thresholds at quantiles, a Poisson
    bootstrap per tree, the square root (classes) or a third (values) of the inputs tried per node. None where there
    are too many inputs or cells. Every tree is grown by a task of its own, from at most CELLS sums."""
    if not 0 < width <= INPUTS:
        return None
    regression = classes == 0
    rows = rows.select(vector_to_array("features").alias("x"), F.col("__y").alias("y")).where("y is not null")
    edges = thresholds(rows, indicators, width)
    counts = cut_lineage(cell_counts(rows, edges, classes), "forest-cells")
    cells = counts.count()
    if not 0 < cells <= CELLS:
        return None
    centre = 0.0
    if regression:
        centre = rows.agg(F.avg("y")).first()[0]
        sums = bagged_sums(rows, edges, trees, centre, seed)
    else:
        sums = counts.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "cell", "v")
    tried = -(-width // 3) if regression else int(np.ceil(np.sqrt(width)))

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        number = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, number, 1])
        bins = np.frombuffer(b"".join(pdf["cell"]), dtype=np.uint8).reshape(len(pdf), width)
        s = np.stack(pdf["v"].to_numpy())
        # a cell's weight is the sum of the weights of its rows, Poisson(1) each
        got = grow(bins, s if regression else rng.poisson(s).astype(float), depth, regression, tried, rng)
        return pd.DataFrame([{"tree": number, **{k: got[k].reshape(-1) for k in ("input", "cut", "left", "sums")}}])

    grown = sums.groupBy("tree").applyInPandas(tree, "tree int, input array<int>, cut array<int>, left array<int>, sums array<double>")
    made = []
    for row in grown.toArrow().sort_by("tree").to_batches():
        for i in range(row.num_rows):
            t = {k: row.column(k)[i].values.to_numpy(zero_copy_only=False) for k in ("input", "cut", "left")}
            s = row.column("sums")[i].values.to_numpy(zero_copy_only=False).reshape(len(t["input"]), -1)
            t["leaf"] = s[:, 1] / np.maximum(s[:, 0], 1e-300) + centre if regression else s / np.maximum(s.sum(axis=1, keepdims=True), 1e-300)
            made.append(t)
    return BinnedForest(edges, made, regression)
