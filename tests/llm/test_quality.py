"""The quality classifier: vectors, gradients, temperature, held-out accuracy."""

import random

import numpy as np
import pyarrow as pa
import pytest
from llm_data import frame, none, odd, prose  # noqa: F401
from pyspark.sql import functions as F

from evenkeel.llm import catalog, quality

LABELS = "doc_id bigint, quality int, toxic int"


def junk(rng, n):
    return " ".join(w + rng.choice(["&&&", "###", "%%%"]) for w in prose(rng, n).split())


@pytest.fixture(scope="module")
def known(spark):
    rng = random.Random(3)
    good = [rng.random() < 0.7 for _ in range(400)]
    docs = frame(spark, [(prose if g else junk)(rng, rng.randint(20, 60)) for g in good])
    return docs, spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(good)], LABELS), good


def test_words_and_neighbours(monkeypatch):
    text = "Ab ab12!! é\n"
    other = "x y"
    data = np.frombuffer((text + other).encode(), dtype=np.uint8)
    slots, first = quality.words(data, np.array([0, len(text.encode()), len(data)]))
    alone = [quality.words(np.frombuffer(w.encode(), dtype=np.uint8), np.array([0, len(w.encode())]))[0][0] for w in ("Ab", "ab", "12", "!!", "é", "x", "y")]
    assert slots.tolist() == alone and first.tolist() == [0, 5, 7]
    index = quality.index_vectors()
    at, count = {}, 0
    monkeypatch.setattr(quality, "WORDS", 3)
    for met, n, sums in quality.contexts(slots, first, index):
        count += n.sum()
        for s, v in zip(met.tolist(), sums):
            at[s] = at.get(s, 0) + v
    assert count == 7
    assert (at[alone[4]] == index[alone[2]].astype(int) + index[alone[3]]).all()
    assert (at[alone[5]] == index[alone[6]]).all()


def test_chunks_cover_whole_texts(monkeypatch):
    monkeypatch.setattr(quality, "CHUNK", 16)
    texts = pa.array(["a" * 5, None, "", "b" * 40, "é", "c" * 15, ""])
    got = []
    for data, edges in quality.chunks(texts.slice(0)):
        got += [bytes(data[a:b]).decode() for a, b in zip(edges, edges[1:])]
    assert got == [x or "" for x in texts.to_pylist()]
    assert [len(e) - 1 for _, e in quality.chunks(texts.slice(3, 2))] == [1, 1]
    assert list(quality.chunks(pa.array([], pa.string()))) == []


def test_pooling_in_pieces(monkeypatch):
    rng = random.Random(9)
    texts = [prose(rng, n).encode() for n in (5, 40, 1)] + [b"", b" "] + [prose(rng, 17).encode()]
    data, edges = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    vectors = np.random.default_rng(1).normal(size=(quality.SLOTS, quality.DIM)).astype(np.float32)
    whole = quality.pooled(vectors, data, edges)
    monkeypatch.setattr(quality, "WORDS", 4)
    assert np.allclose(quality.pooled(vectors, data, edges), whole, atol=1e-6)
    slots, first = quality.words(data, edges)
    one = vectors[slots[first[1] : first[2]]].astype(float)
    assert np.allclose(whole[1], [*one.mean(axis=0), *one.std(axis=0), np.log1p(len(one))], atol=1e-5) and not whole[3].any()


def test_gradients():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(30, 6)), rng.integers(0, 2, 30).astype(float)
    net = quality.Network(np.zeros(6), np.ones(6), [rng.normal(size=(6, 5)), rng.normal(size=5), rng.normal(size=5), np.array(0.3)])
    _, grads = net.gradients(x, y)
    for w, g in zip(net.w, grads):
        flat = w.reshape(-1)
        for i in rng.choice(flat.size, min(4, flat.size), replace=False):
            kept, step = flat[i].copy(), 1e-6
            flat[i] = kept + step
            up = net.gradients(x, y)[0]
            flat[i] = kept - step
            down = net.gradients(x, y)[0]
            flat[i] = kept
            assert (up - down) / (2 * step) == pytest.approx(g.reshape(-1)[i], abs=1e-6)


def test_temperature_is_the_best():
    rng = np.random.default_rng(2)
    z = rng.normal(0, 4, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z / 3))).astype(float)
    t = quality.calibrate(z, y)
    loss = lambda t: np.mean(np.logaddexp(0, z / t) - y * z / t)
    assert abs(t - 3) < 0.4 and loss(t) <= min(loss(x) for x in np.linspace(0.5, 10, 300)) + 1e-9


def test_held_out_documents(known):
    docs, labels, good = known
    learned = quality.fit(docs, labels, F.col("doc_id") % 4 != 2)
    out = {r.doc_id: r.score for r in quality.score(docs, learned).collect()}
    held = [i for i in range(400) if i % 4 == 2]
    assert np.mean([(out[i] >= 0.7) == good[i] for i in held]) > 0.95
    again = quality.fit(docs.repartition(5), labels.repartition(3), F.col("doc_id") % 4 != 2)
    assert np.abs(again.vectors - learned.vectors).max() == 0
    assert all(out[r.doc_id] == pytest.approx(r.score, abs=1e-9) for r in quality.score(docs, again).collect())


def test_odd_rows(spark, known, odd, none):
    docs, labels, _ = known
    learned = quality.fit(docs, labels, F.lit(True))
    got = quality.score(odd, learned).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.score)
    # null, empty and blank texts have no words
    assert by[0] == by[1] == by[2]
    assert quality.score(none, learned).count() == 0


@pytest.mark.parametrize("labelled", [[], [(0, 1, 0), (1, 1, 0)], [(None, 0, 0), (2, None, 0)]])
def test_without_labels_of_both_kinds(spark, known, labelled):
    learned = quality.fit(known[0], spark.createDataFrame(labelled, LABELS), F.lit(True))
    scores = {r.score for r in quality.score(known[0], learned).collect()}
    assert scores == ({1.0} if labelled and labelled[0][0] == 0 else {0.5})


def test_empty_documents_with_labels(none, known):
    assert quality.fit(none, known[1], F.lit(True)).network is None


def test_registered(spark):
    out = catalog.QUERIES["op11_quality"](spark, "/root/testdata/sf0.001")
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert all(r.predicted == int(r.score >= 0.7) for r in out.collect())
