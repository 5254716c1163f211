"""Mixing, sharding and token files."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_data import frame, none, odd, prose, rows  # noqa: F401
from pyspark.sql import functions as F

from evenkeel.llm import mixing, sharding, tokens
from evenkeel.llm.common import word_count
from evenkeel.llm.pfor import TokenFile, encode_file, read_tokens
from evenkeel.session import cut_lineage


def fill(sizes, weights, cap):
    """Targets by sharing the excess again and again."""
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_ = sum(weights[s] for s in sizes if s not in full)
        out = {s: cap * sizes[s] if s in full else left * weights[s] / open_ for s in sizes}
        over = {s for s in sizes if s not in full and out[s] > cap * sizes[s]}
        if not over:
            return out
        full |= over


def test_targets_are_filled_by_weight(spark):
    rng = random.Random(5)
    names = ["é", "a", "Z", None, "b", "aa"] + [f"s{i:02d}" for i in range(12)]
    data = [(i, rng.choice(names), rng.choice([0, 1, 3, 10, 200])) for i in range(600)]
    data += [(1000, "tiny", 1), (1001, "zero", 0)]
    df = cut_lineage(spark.createDataFrame(data, "doc_id bigint, source string, size bigint").repartition(4), "t")
    got = mixing.mix(df, (1, 2, 3), "source", "size", ["doc_id"], seed=1).collect()
    sizes = defaultdict(int)
    for _, s, n in data:
        sizes[s] += n
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = fill(sizes, {s: i % 3 + 1 for i, s in enumerate(order)}, 3.0)
    taken = Counter()
    assert len(got) == len(data)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 3 and math.floor(r.rate) <= r.copies <= math.floor(r.rate) + 1
        taken[r.source] += r.size * r.copies
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 250
    again = mixing.mix(df.repartition(7), (1, 2, 3), "source", "size", ["doc_id"], seed=1)
    assert {(r.doc_id, r.copies) for r in got} == {(r.doc_id, r.copies) for r in again.collect()}
    assert mixing.emit(again, ["doc_id"]).count() == sum(r.copies for r in got)


def test_a_row_is_copied_as_often_as_its_fraction_says(spark):
    df = spark.range(400).select("id", F.lit("s").alias("__source"), F.lit(0.3).alias("rate"), F.lit(1).alias("salts"), (F.col("id") % 9).alias("size"))
    counts = [mixing.draw(df, "size", ["id"], seed).where("copies = 1").count() for seed in range(5)]
    assert all(abs(c - 120) <= 1 for c in counts)
    first = [mixing.draw(df, "size", ["id"], s).where("id = 0").first().copies for s in range(40)]
    assert 4 <= sum(first) <= 22


def test_given_weights_and_odd_rows(spark, odd, none):
    weights = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "source string, weight double")
    sized = lambda df: cut_lineage(df.select("doc_id", "source", word_count(F.col("text")).alias("size")), "t")
    got = mixing.mix(sized(odd), weights, "source", "size", ["doc_id"]).collect()
    assert len(got) == 12 and {r.copies for r in got if r.source != "a"} == {0}
    assert len(mixing.mix(sized(odd), (1, 2, 3), "source", "size", ["doc_id"]).collect()) == 12
    assert mixing.mix(sized(none), (1, 2, 3), "source", "size", ["doc_id"]).count() == 0


def brute_fit(sizes, capacity, bins=None):
    room, out = [capacity] * (bins or 0), []
    for s in sizes:
        fits = [(r, b) for b, r in enumerate(room) if r >= s]
        if fits:
            b = min(fits)[1]
        elif bins:
            b = max(range(bins), key=lambda i: (room[i], i))
        else:
            room.append(max(capacity, s))
            b = len(room) - 1
        room[b] -= s
        out.append(b)
    return out


@pytest.mark.parametrize("bins", [None, 7])
def test_best_fit_decreasing(bins):
    rng = random.Random(6)
    for _ in range(30):
        sizes = sorted((rng.randint(1, 60) for _ in range(rng.randint(0, 80))), reverse=True)
        assert sharding.best_fit_decreasing(sizes, 64, bins) == brute_fit(sizes, 64, bins)


def test_shards_keep_groups_together_and_even(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUPS_PER_TASK", 50)
    monkeypatch.setattr(sharding, "SLOTS_PER_TASK", 20)
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(1, 80)) for _ in range(500)] + ["same text é"] * 60 + [None, ""]
    got = sharding.shard_rows(frame(spark, texts).repartition(4), shards=4).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    place, slots, sizes = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        place[data].add(r.shard)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(len(s) == 1 for s in place.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) == {0, 1, 2, 3} and max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values())


@pytest.mark.parametrize("count", [{"shards": 9}, {"capacity": 2000}])
def test_shards_are_the_same_on_any_cluster(spark, monkeypatch, count):
    for name, n in (("GROUPS_PER_TASK", 50), ("SLOTS_PER_TASK", 20), ("SHARDS_TOGETHER", 4), ("GRAINS", 16)):
        monkeypatch.setattr(sharding, name, n)
    rng = random.Random(9)
    texts = [prose(rng, rng.randint(1, 20)) for _ in range(300)] + ["same text"] * 20
    found, parts = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (3, 31):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(rows(sharding.shard_rows(frame(spark, texts).repartition(n), **count)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert found[0] == found[1] and len(found[0]) == 320
    sizes = Counter()
    for _, size, _, shard, _ in found[0]:
        sizes[shard] += size
    assert sorted(sizes) == list(range(len(sizes)))
    if "shards" in count:
        # ranges of about 50 units each differ by chance
        assert len(sizes) == 9 and max(sizes.values()) < 1.5 * min(sizes.values())
    else:
        assert max(sizes.values()) <= 2000 and len(sizes) <= -(-sum(sizes.values()) // 2000) + 6


def test_fixed_capacity_opens_few_shards(spark):
    rng = random.Random(8)
    texts = ["x" * rng.randint(5, 300) + str(i) for i in range(200)]
    got = sharding.shard_rows(frame(spark, texts), capacity=2000)
    sizes = [r.s for r in got.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert max(sizes) <= 2000 and len(sizes) <= -(-sum(sizes) // 2000) + 2


def test_placed_rows_have_slots_of_their_own(spark, odd, none):
    assert sharding.shard_rows(odd, shards=3).count() == 12
    repeated = frame(spark, ["a b", "a b", "a b", "c"], [1, 1, 2, None], sources=["q"] * 4)
    got = sharding.place_rows(repeated, shards=2)
    assert got.columns == [*(c for c in repeated.columns if c != "shard"), "shard", "slot"]
    assert len({tuple(r)[-2:] for r in got.collect()}) == 4
    assert sharding.shard_rows(none, shards=3).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_rows(none)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
@pytest.mark.parametrize("high", [1, 2, 300, 50_000, 2**32 - 1])
def test_blocks_round_trip(n, high):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    ids[rng.random(n) < 0.05] = 2**32 - 1
    data = np.frombuffer(encode_file(ids, [5, None], [n, 0]), np.uint8)
    file = TokenFile.read(data)
    assert (read_tokens(data, file, 0, n) == ids).all()
    assert (file.n_tokens, file.doc_ids.tolist(), file.has_id.tolist(), file.counts.tolist()) == (n, [5, 0], [True, False], [n, 0])
    a, b = sorted(rng.integers(0, n + 1, 2))
    assert (read_tokens(data, file, a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        TokenFile.read(data[:-1])


def test_token_files_equal_whole_text_encoding(spark, odd, none, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "CACHED_PIECES", 50)
    path = tokens.default_vocabulary()
    rng = random.Random(9)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(60)]
    texts += [None, "", "Tabs\tand   odd spaces\x1c\x1f", "<|endoftext|> it's\n\n42 ÀÉ é ́x", "x" * 5000, "同じ 文字", "a\r\nb c", "İ ΑΣ ΣΑ"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    files = tokens.write_tokens(frame(spark, texts, ids).repartition(3), str(tmp_path / "t"), path, parts=3, file_tokens=500)
    got = tokens.read_documents(files, str(tmp_path / "t")).orderBy("doc_id").collect()
    whole, start = Tokenizer.from_file(path), 0
    by_id = dict(zip(ids, texts))
    assert files.count() > 3
    for r in got:
        want = np.array(whole.encode(by_id[r.doc_id] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes())), by_id[r.doc_id]
        start += len(want)
    files = tokens.write_tokens(odd, str(tmp_path / "o"), path)
    assert [r.doc_id for r in tokens.read_documents(files, str(tmp_path / "o")).orderBy("start").collect()][:3] == [None, None, 0]
    files = tokens.write_tokens(none, str(tmp_path / "n"), path)
    assert tokens.read_documents(files, str(tmp_path / "n")).count() == 0


def test_pieces_equal_whole_texts_and_other_vocabularies_are_told_apart(monkeypatch):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "CACHED_PIECES", 300)
    monkeypatch.setattr(tokens, "LONGEST_CACHED", 12)
    rng = random.Random(12)
    marks = ("", ".", ",", "..", "\n", "  ", "́", "É'S", "<|endoftext|>", " ", " ", "İ", "x" * 40, "7,", "don't.", "\r\n\t")
    texts = ["".join(rng.choice([prose(rng, 2), rng.choice(marks), " "]) for _ in range(40)) for _ in range(150)] + ["", " ", "\n"]
    for name, known in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        encode, plain = tokens.Encoder(path), Tokenizer.from_file(path)
        assert encode.by_pieces is known
        want = [np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        for at in range(0, len(texts), 40):
            assert encode(texts[at : at + 40]) == want[at : at + 40]
        assert encode([]) == []
    spec = json.loads(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).to_str())
    assert tokens.independent(spec)
    assert not tokens.independent({**spec, "normalizer": None}) and not tokens.independent({**spec, "pre_tokenizer": None})
