"""Quality of documents: random-indexing word vectors, pooled, and a two-layer network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.neardup import Powers, mixed
from evenkeel.operators.sizing import broadcast_if_small

#: The network is fitted on about this many labelled documents, chosen by a hash of the id. The
#: word vectors are of all documents and whole texts.
FIT_DOCS = 10_000
#: Words share 2**SLOT_BITS slots; their vectors have DIM numbers, an index vector SPARSE of +1 or -1.
SLOT_BITS, DIM, SPARSE, REACH = 14, 48, 4, 2
SLOTS = 1 << SLOT_BITS
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 120, 128, 3e-3, 1e-4
#: Of the labelled documents a fifth only sets the temperature.
CALIBRATION = 5
#: Bytes of texts, and words, that a task works on at once.
CHUNK, WORDS = 1 << 20, 1 << 16

_rng = np.random.default_rng(11)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
# 0 space, 1 letter, 2 digit, 3 other; whatever is not ASCII counts as a letter
_KIND = np.full(256, 3, dtype=np.int8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


def index_vectors() -> np.ndarray:
    """Sparse random vectors of all slots; the last row, of no slot, is zero."""
    rng = np.random.default_rng(12)
    out = np.zeros((SLOTS + 1, DIM), dtype=np.int8)
    at = rng.random((SLOTS, DIM)).argpartition(SPARSE, axis=1)[:, :SPARSE]
    np.put_along_axis(out[:SLOTS], at, rng.choice(np.array([-1, 1], dtype=np.int8), (SLOTS, SPARSE)), axis=1)
    return out


def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes of some texts in a row, where each begins and the last ends), at most about CHUNK
    bytes unless one text is longer. A null text is empty."""
    texts = texts.fill_null("").cast(pa.large_binary())
    edges = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + CHUNK, side="right")) - 1)
        yield data[edges[at] : edges[to]], edges[at : to + 1] - edges[at]
        at = to


def words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each word, number of words before each text and in all).

    A word is a run of letters, of digits or of other characters, as written: capitals count."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(len(edges), dtype=np.int64)
    kind = _KIND[data]
    cut = np.ones(n, dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    cut[edges[:-1][edges[:-1] < n]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n)
    some = kind[start] > 0
    start, end = start[some], end[some]
    Powers.reach(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * Powers.up[:n], out=sums[1:])
    h = mixed((sums[end] - sums[start]) * Powers.down[start] + (end - start).astype(np.uint64))
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), np.searchsorted(start, edges)


def contexts(slots: np.ndarray, first: np.ndarray, index: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(slots met, their counts, sums of the index vectors of up to REACH words on either side), in
    pieces to be added up."""
    gaps = np.repeat(first, REACH)  # words of different texts are not neighbours
    apart = np.insert(slots, gaps, SLOTS)
    places = np.flatnonzero(apart < SLOTS)
    for at in range(0, len(places), WORDS):
        own = places[at : at + WORDS]
        near = np.zeros((len(own), DIM), dtype=np.int16)
        for o in range(-REACH, REACH + 1):
            if o:
                near += index[apart[own + o]]
        here = apart[own]
        order = np.argsort(here.astype(np.uint16), kind="stable")
        met, start, n = np.unique(here[order], return_index=True, return_counts=True)
        yield met, n, np.add.reduceat(near[order], start, axis=0, dtype=np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """A unit vector per slot (zero for slots never met) from ``docs`` (text).

    Tasks sum up what surrounds each slot, and the sums are aggregated; the driver gets one row
    per slot, SLOTS at most."""
    names = [f"v{i}" for i in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        count, total = np.zeros(SLOTS, dtype=np.int64), np.zeros((SLOTS, DIM), dtype=np.int64)
        for batch in batches:
            for data, edges in chunks(batch.column("text")):
                for met, n, sums in contexts(*words(data, edges), index):
                    count[met] += n
                    total[met] += sums
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(count[met]), *[pa.array(total[met, i]) for i in range(DIM)]], names=["slot", "n", *names])

    schema = ", ".join(f"{c} bigint" for c in ["slot", "n", *names])
    summed = docs.select("text").mapInArrow(run, schema).groupBy("slot").agg(*[F.sum(c).alias(c) for c in ["n", *names]])
    rows = summed.toArrow()
    out = np.zeros((SLOTS, DIM))
    if rows.num_rows:
        slot, n = rows["slot"].to_numpy(), rows["n"].to_numpy()
        sums = np.stack([rows[c].to_numpy() for c in names], axis=1).astype(float)
        mean = sums / n[:, None] - sums.sum(axis=0) / n.sum()
        out[slot] = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)
    return out.astype(np.float32)


def pooled(vectors: np.ndarray, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Per text the mean and deviation of its words' vectors and the logarithm of their number."""
    slots, first = words(data, edges)
    n = np.diff(first)
    mean, square = np.zeros((len(n), DIM)), np.zeros((len(n), DIM))
    for at in range(0, len(slots), WORDS):
        to = min(at + WORDS, len(slots))
        found = vectors[slots[at:to]]
        here = np.clip(first, at, to) - at
        some = np.flatnonzero(np.diff(here))
        mean[some] += np.add.reduceat(found, here[some], axis=0, dtype=np.float64)
        square[some] += np.add.reduceat(found * found, here[some], axis=0, dtype=np.float64)
    size = np.maximum(n, 1)[:, None]
    mean, square = mean / size, square / size
    return np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0)), np.log1p(n)[:, None]], axis=1)


@dataclass
class Network:
    """One hidden layer over standardised inputs; ``temperature`` divides the logit."""

    centre: np.ndarray
    scale: np.ndarray
    w: list[np.ndarray]
    temperature: float = 1.0

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(x @ self.w[0] + self.w[1])
        return hidden, hidden @ self.w[2] + self.w[3]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Cross-entropy of standardised ``x``, and its gradients."""
        hidden, z = self._forward(x)
        loss = float(np.mean(np.logaddexp(0, z) - y * z)) + DECAY / 2 * float((self.w[0] ** 2).sum() + (self.w[2] ** 2).sum())
        dz = (1 / (1 + np.exp(-z)) - y) / len(y)
        dh = np.outer(dz, self.w[2]) * (1 - hidden**2)
        return loss, [x.T @ dh + DECAY * self.w[0], dh.sum(axis=0), hidden.T @ dz + DECAY * self.w[2], np.array(dz.sum())]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self._forward((x - self.centre) / self.scale)[1]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Adam over shuffled batches, the same for the same rows."""
    rng = np.random.default_rng(seed)
    scale = x.std(axis=0)
    net = Network(x.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), [
        rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(()),
    ])
    x = (x - net.centre) / net.scale
    first, second, step = [np.zeros_like(w) for w in net.w], [np.zeros_like(w) for w in net.w], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            some, step = order[at : at + BATCH], step + 1
            for i, g in enumerate(net.gradients(x[some], y[some])[1]):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                move = first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
                net.w[i] = net.w[i] - RATE * (1 - epoch / EPOCHS) * move
    return net


def calibrate(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature under which logits ``z`` give ``y`` the least cross-entropy: golden section
    over its logarithm, in which the loss has one minimum."""
    loss = lambda t: float(np.mean(np.logaddexp(0, z / np.exp(t)) - y * z / np.exp(t)))
    low, high, part = np.log(0.05), np.log(50.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class Model:
    """Word vectors and network; without labels of both kinds ``network`` is None and every score is ``prior``."""

    vectors: np.ndarray
    network: Network | None
    prior: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.prior)
        found = [self.network.scores(pooled(self.vectors, *c)) for c in chunks(texts)]
        return np.concatenate(found) if found else np.zeros(0)


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", fit_docs: int = FIT_DOCS,
) -> Model:
    """Vectors from all rows of ``docs``, the network from the ``usable`` ones of ``labels`` (id, label).

    Several labels of one id count as their mean; null ids and labels teach nothing. A hash of
    the id picks about ``fit_docs`` of them."""
    known = labels.where(usable & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.avg(F.col(label_col).cast("double")).alias("__y"))
    n = known.count()
    rate = min(1.0, fit_docs / max(n, 1))
    draw = F.pmod(F.xxhash64("__id", F.lit("fit")), F.lit(1_000_003)) / 1_000_003.0
    chosen = known.where(draw < rate)
    vectors = word_vectors(docs.select(F.col(text_col).cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pooled(vectors, *c) for c in chunks(batch.column("text"))]
            x = np.concatenate(found) if found else np.zeros((0, 2 * DIM + 1))
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__y"), pa.array(list(x), pa.list_(pa.float64()))], names=["__id", "__y", "x"])

    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(broadcast_if_small(chosen), "__id").select("__id", "__y", "text")
    kind = rows.schema["__id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"__id {kind}, __y double, x array<double>").toPandas()
    if not len(got):
        return Model(vectors, None, 0.5)
    # rows of one id come in the order of their inputs
    x = np.stack(got["x"].to_numpy())
    order = np.lexsort([*x.T[::-1], got["__id"].rank(method="dense").to_numpy()])
    x, y = x[order], got["__y"].to_numpy()[order]
    if y.min() == y.max():
        return Model(vectors, None, float(y.mean()))
    apart = np.arange(len(y)) % CALIBRATION == CALIBRATION - 1
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        return Model(vectors, train(x, y), float(y.mean()))
    network = train(x[~apart], y[~apart])
    network.temperature = calibrate(network.logits(x[apart]), y[apart])
    return Model(vectors, network, float(y.mean()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score), the calibrated probability of a high label, one row per row of ``docs``.

    Only the text decides. A null text is an empty one, scored as a text without words; any
    length is read whole. An empty table gives an empty result. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.scores(batch.column("text")), pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
