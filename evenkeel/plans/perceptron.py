"""Multilayer perceptrons: limited-memory BFGS, every loss and gradient one pass over stored rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.session import cut_lineage

#: Rows of a matrix that a task works on at once; steps that the solver remembers.
BLOCK, MEMORY = 1024, 10
TOLERANCE, ARMIJO, WOLFE, TRIES = 1e-6, 1e-4, 0.9, 30


def unpacked(w: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, intercepts) of each layer from one vector."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def start(layers: Sequence[int], seed: int) -> np.ndarray:
    """Uniform weights that keep a sigmoid's inputs in its steep part."""
    rng = np.random.default_rng(seed)
    bounds = [np.sqrt(6.0 / (a + b)) for a, b in zip(layers, layers[1:])]
    return np.concatenate([rng.uniform(-u, u, a * b + b) for u, a, b in zip(bounds, layers, layers[1:])])


def forward(x: np.ndarray, parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The outputs of all layers: sigmoids, and the classes' shares at the end."""
    out = [x]
    for i, (w, b) in enumerate(parts):
        z = out[-1] @ w
        z += b
        if i + 1 < len(parts):
            z *= 0.5
            np.tanh(z, out=z)
            z += 1
            z *= 0.5
        else:
            z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            z /= z.sum(axis=1, keepdims=True)
        out.append(z)
    return out


def loss_and_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, layers: Sequence[int]) -> tuple[float, np.ndarray]:
    """Summed cross-entropy of classes ``y`` and its gradient."""
    parts = unpacked(w, layers)
    out = forward(x, parts)
    rows = np.arange(len(y))
    loss = -float(np.log(np.maximum(out[-1][rows, y], np.finfo(x.dtype).tiny)).sum(dtype=float))
    delta, found = out[-1].copy(), []
    delta[rows, y] -= 1
    for i in range(len(parts) - 1, -1, -1):
        found.append(np.concatenate([(out[i].T @ delta).reshape(-1), delta.sum(axis=0)]))
        if i:
            delta = delta @ parts[i][0].T
            delta *= out[i] * (1 - out[i])
    return loss, np.concatenate(found[::-1])


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int) -> np.ndarray:
    """Limited-memory BFGS; a step is taken where it lowers the loss and the slope enough (weak Wolfe
    conditions, by bisection). It ends after ``steps`` steps or where loss or gradient stand still."""
    value, g = f(w)
    old: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.linalg.norm(g) <= TOLERANCE * max(abs(value), 1e-300):
            break
        move, shares = -g, []
        for s, d in reversed(old):
            a = (s @ move) / (s @ d)
            shares.append(a)
            move = move - a * d
        if old:
            s, d = old[-1]
            move = move * ((s @ d) / (d @ d))
        for (s, d), a in zip(old, reversed(shares)):
            move = move + (a - (d @ move) / (s @ d)) * s
        slope = float(g @ move)
        if slope >= 0:
            old, move, slope = [], -g, -float(g @ g)
        t, low, high = 1.0 if old else min(1.0, 1 / float(np.linalg.norm(g))), 0.0, np.inf
        best = None
        for _ in range(TRIES):
            new, slopes = f(w + t * move)
            if not new <= value + ARMIJO * t * slope:
                high = t
            else:
                best = (t, new, slopes)
                if float(slopes @ move) >= WOLFE * slope:
                    break
                low = t
            t = 2 * low if high == np.inf else (low + high) / 2
        if best is None:
            if not old:
                break
            old = []  # start again from the gradient
            continue
        t, new, slopes = best
        s, d = t * move, slopes - g
        if s @ d > 1e-12 * np.sqrt((s @ s) * (d @ d)):
            old = [*old[1 - MEMORY :], (s, d)]
        still = abs(value - new) <= TOLERANCE * max(abs(value), abs(new), 1e-6)
        w, value, g = w + s, new, slopes
        if still:
            break
    return w


@dataclass(frozen=True)
class Perceptron:
    layers: Sequence[int]
    weights: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` (features) with ``probability`` and ``prediction``."""
        layers, weights = list(self.layers), self.weights

        @F.arrow_udf("array<double>")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            parts = unpacked(weights, layers)
            for column in batches:
                x = pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), layers[0])
                out = np.concatenate([forward(x[a : a + BLOCK], parts)[-1] for a in range(0, len(x), BLOCK)] or [np.zeros((0, layers[-1]))])
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * layers[-1], pa.int32()), pa.array(out.reshape(-1)))

        scored = df.withColumn("__s", score(vector_to_array("features")))
        largest = (F.array_position("__s", F.array_max("__s")) - 1).cast("double")
        return scored.withColumn("probability", array_to_vector("__s")).withColumn("prediction", largest).drop("__s")


def fit_perceptron(rows: DataFrame, layers: Sequence[int], steps: int, seed: int) -> Perceptron:
    """Fit on all ``rows`` (features, __y 0..k-1). Rows are stored once; tasks sum the loss and gradient of their rows, and
    the driver gets one vector a pass."""
    stored = cut_lineage(rows.where("__y is not null").select(vector_to_array("features").alias("x"), F.col("__y").cast("int").alias("y")), "perceptron-rows")

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
        single = w.astype(np.float32)  # products in single, sums over blocks in double precision

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                x = pc.list_flatten(batch.column("x")).to_numpy(zero_copy_only=False).reshape(batch.num_rows, layers[0]).astype(np.float32)
                y = batch.column("y").to_numpy(zero_copy_only=False)
                for a in range(0, len(y), BLOCK):
                    loss, g = loss_and_gradient(x[a : a + BLOCK], y[a : a + BLOCK], single, layers)
                    v = np.concatenate([[len(y[a : a + BLOCK]), loss], g.astype(float)])
                    total = v if total is None else total + v
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

        parts = stored.mapInArrow(run, "v array<double>").select(array_to_vector("v").alias("v"))
        v = parts.agg(Summarizer.sum(F.col("v")).alias("v")).first()["v"].toArray()
        return v[1] / v[0], v[2:] / v[0]

    return Perceptron(layers, minimise(evaluate, start(layers, seed), steps))
