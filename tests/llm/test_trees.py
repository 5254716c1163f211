"""Merkle manifests and prefix tries against brute force."""

import hashlib
import math
import random
import zlib

import pyarrow as pa
import pytest
from llm_data import frame, none, odd, prose  # noqa: F401
from pyspark.sql import functions as F

from evenkeel.llm import catalog, merkle, trie
from evenkeel.llm.order import positions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def grow(nodes, fan):
    levels = [nodes]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([sha("".join(at[i : i + fan])) for i in range(0, len(at), fan)])
    return levels


def siblings(levels, i, fan):
    out = []
    for at in levels[:-1]:
        run = i // fan * fan
        out.append(("".join(at[run:i]), "".join(at[i + 1 : run + fan])))
        i //= fan
    return out


def brute(rows, fan, struck):
    """{(id, leaf, subroot, root, proof, folded)}, as a sorted list."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = grow([leaf(r) for r in groups[g]], fan)
    head = grow([trees[g][-1][0] for g in order], fan)
    out = []
    for n, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            path = siblings(trees[g], i, fan) + siblings(head, n, fan)
            node = leaf(dict(r, n_chars=r["n_chars"] + 1)) if r["n_chars"] is not None and struck(r) else leaf(r)
            for left, right in path:
                node = sha(left + node + right)
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], head[-1][0], sha("".join(a + b for a, b in path)), node))
    return sorted(out, key=repr)


def struck(row):
    return row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0


@pytest.mark.parametrize("fan,block", [(2, 4), (3, 9)])
def test_manifest_equals_brute_force(spark, fan, block):
    rng = random.Random(fan * block)
    langs = ["en"] * 6 + ["de", "é", "", None, "z"]
    texts = [rng.choice([None, "", prose(rng, 5), "same", "ünï"]) for _ in range(150)]
    ids = [rng.choice([None, *range(120)]) for _ in range(150)]
    # one language has one row
    docs = frame(spark, texts, ids, langs=[rng.choice(langs) for _ in range(149)] + ["alone"], sources=[rng.choice(["a", None]) for _ in range(150)])
    docs = docs.withColumn("n_chars", F.when(F.rand(3) > 0.1, F.length("text"))).withColumns({"g": F.lit(1), "pos": F.lit("p"), "n": F.lit(0), "block": F.lit(2), "top": F.lit("t"), "path": F.lit(3)})
    stored = spark.createDataFrame(docs.collect(), docs.schema)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = merkle.manifest(stored, {"n_chars": F.col("n_chars") + 1}, hit, fan=fan, block=block)
    got = out.withColumn("proof", merkle.digest_of(merkle.proof_text(F.col("path")))).select("doc_id", "leaf", "subroot", "root", "proof", "folded_root")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute([r.asDict() for r in stored.collect()], fan, struck)
    assert got.where("folded_root <> root").count() > 0


def test_manifest_of_odd_rows(odd, none):
    assert merkle.manifest(none).count() == 0
    out = merkle.manifest(odd)
    assert out.count() == odd.count() and out.where("folded_root <> root").count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(odd, fan=1)


def test_single_row_is_its_own_root(spark):
    row = merkle.manifest(frame(spark, ["x"], [7])).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.path == []


def test_positions_are_gapless(spark):
    rng = random.Random(4)
    data = [(rng.choice(["hot", "hot", None, "b"]), rng.choice([None, *range(50)]), i) for i in range(2000)]
    df = spark.createDataFrame(data, "g string, x int, i int").repartition(7)
    got = {}
    for r in positions(df, ["g"], ["x", "i"]).collect():
        got.setdefault(r.g, []).append(((r.x is not None, r.x or 0, r.i), r.pos))
    for rows in got.values():
        assert [p for _, p in sorted(rows)] == list(range(len(rows)))


# --- tries --------------------------------------------------------------------------------

def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    h = lambda c: zlib.crc32(str(c).encode()) % 9
    whole = {c: own.get(c - int(math.fmod(c, 5)), [])[: h(c)] + own[c][h(c) :] for c in own}
    nodes = {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    out = []
    for k, members in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        kids = lambda x: sum(1 for y in nodes if len(y) == len(x) + 1 and y[: len(x)] == x)
        saved = sum((len(nodes[x]) - 1) * (len(x[-1][1].encode()) if x else 0) for x in below)
        ends = ",".join(map(str, sorted(c for c in members if len(whole[c]) == len(k))))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), kids(k), sum(1 for x in below if not kids(x)), saved, sha(ends)))
    return sorted(out, key=repr)


def talks(rng, n):
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        long = 40 if c % 20 == 5 else rng.randint(1, 10)
        same = rng.random() < 0.4
        for t in range(long):
            turn = None if t == 0 and rng.random() < 0.2 else t
            rows.append((c, turn, rng.choice(["user", None]) if not same else "user", "hi" if same or rng.random() < 0.5 else rng.choice([None, "", "yö", "no"])))
    return rows + [(None, 1, "user", "lost"), (-3, 0, "user", "hi"), (-3, 0, "user", "hi")]


TALK = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("spread,band", [(3, 12), (1024, 4096)])
def test_trie_equals_brute_force(spark, spread, band, monkeypatch):
    monkeypatch.setattr(trie, "STRETCH", 5)
    monkeypatch.setattr(trie, "JOINED", 3)
    rows = talks(random.Random(spread), 90)
    df = spark.createDataFrame(rows, TALK).withColumns({"c": F.lit(1), "key": F.lit(2), "depth": F.lit("d")})
    assert sorted((tuple(r) for r in trie.prefix_trie(df, spread, band).collect()), key=repr) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TALK)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], TALK)).count() == 0


def test_queue_spills_and_keeps_order():
    rng = random.Random(1)
    queue, got = trie.SpillingQueue(50), []
    items = [(rng.randint(-40, 0), str(rng.randint(0, 9)), i, i) for i in range(1000)]
    for i, x in enumerate(items):
        queue.push(x)
        if i % 10 == 9:
            assert queue.first() == (y := queue.pop())
            got.append(y)
    assert queue.spills > 3
    rest = []
    while queue:
        assert queue.first() == (y := queue.pop())
        rest.append(y)
    assert rest == sorted(rest) and sorted(got + rest) == sorted(items)


def test_forward_with_a_tiny_queue():
    """A root over a hundred pairs, in reverse level order."""
    nodes = [("r", 2, f"b{i:03}", f"a{i:03}", 1, 5, 0, 0) for i in range(100)] + [("r", 1, f"a{i:03}", "r", 0, 2, 1, 3) for i in range(100)] + [("r", 0, "r", None, 0, 0, 0, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*nodes)], names=trie.FIELDS)
    got = {k: (a, b) for out in trie.forward(iter([batch.slice(0, 37), batch.slice(37)]), limit=7) for k, a, b in zip(*[c.to_pylist() for c in out.columns])}
    assert got["r"] == (200, 1000) and got["a007"] == (2, 10) and got["b007"] == (1, 5)


def test_registered_manifest_marks_tampered_rows(spark):
    out = catalog.QUERIES["op13_merkle"](spark, "/root/testdata/sf0.001").collect()
    assert {r.verified for r in out} == {True, False}
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in out)
