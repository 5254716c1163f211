"""Exact, near and line deduplication against brute force."""

import hashlib
import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from llm_data import frame, none, odd, prose, rows  # noqa: F401
from pyspark.sql import functions as F

from evenkeel.llm import exact, lines, neardup, stars
from evenkeel.llm.graph import components
from evenkeel.session import shared_dir


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 201)]
    found = components(spark.createDataFrame(pairs, "a bigint, b bigint"))
    groups = defaultdict(set)
    for r in found.collect():
        groups[r.root].add(r.v)
    assert sorted(map(sorted, groups.values())) == [list(range(41)), list(range(100, 140)), [200, 201]]


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(spark, keep, monkeypatch):
    monkeypatch.setattr("evenkeel.llm.common.HOT", 5)
    rng = random.Random(2)
    texts = [rng.choice(["hot", "hot", f"t{i % 40}", None, ""]) for i in range(300)]
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    pick = min if keep == "min" else max
    want = sorted((i, pick(g), len(g), i == pick(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert rows(exact.exact_dedup(frame(spark, texts).repartition(5), keep=keep)) == sorted(want, key=repr)


def test_exact_dedup_odd(odd, none):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(odd).collect()}
    assert {(0, 0, 3, True), (1, 0, 3, False), (None, 0, 3, False), (3, 3, 2, True), (4, 3, 2, False), (6, 6, 2, True), (None, None, 1, True)} <= got
    assert exact.exact_dedup(odd).count() == 12
    assert exact.exact_dedup(none).count() == 0


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def near_brute(texts, n=5):
    sets = [shingles(t, n) for t in texts]
    pairs = [
        (a, b) for a in range(len(sets)) for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    found = roots(len(sets), pairs)
    least = {r: min(i for i, x in enumerate(found) if x == r) for r in found}
    return [(i, len(s), least[found[i]], least[found[i]] == i) for i, s in enumerate(sets)]


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = prose(rng, 1)
    return " ".join(words)


@pytest.mark.parametrize("shingle", [4, 5])
def test_near_duplicates_equal_brute_force(spark, shingle):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(60)]
    common = prose(rng, 40)
    texts += [common + " " + prose(rng, 40) for _ in range(25)]  # half the words shared: no links
    for size, n, changes in ((120, 25, 2), (30, 12, 1), (200, 40, 4), (9, 10, 1)):
        base = prose(rng, size).split()
        texts += [edited(rng, base, changes) for _ in range(n)]
    chain = prose(rng, 100).split()
    for _ in range(12):  # each near the one before only
        chain[:3] = []
        chain += prose(rng, 3).split()
        texts.append(" ".join(chain).upper())
    texts += ["one two", "ONE  two", "one two three", "", None, " \n"]
    rng.shuffle(texts)
    got = rows(neardup.near_duplicates(frame(spark, texts).repartition(4), shingle=shingle))
    assert got == sorted(near_brute(texts, shingle), key=repr)


def test_near_duplicates_odd(odd, none):
    got = {tuple(r) for r in neardup.near_duplicates(odd).collect()}
    assert {(0, 0, 0, True), (2, 0, 2, True), (5, 1, 5, True), (6, 1, 5, False), (4, 29996, 3, False)} <= got
    assert {(r[2], r[3]) for r in got if r[0] is None} == {(None, True)}
    assert neardup.near_duplicates(odd).count() == 12
    assert neardup.near_duplicates(none).count() == 0


def test_densified_bins_agree_as_often_as_sets_do():
    rng, sign = np.random.default_rng(0), neardup.Signatures()
    for size in (5, 40, 3000):
        agree = []
        for _ in range(40):
            both = rng.integers(0, 1 << 64, size, dtype=np.uint64)
            a, b = np.unique(both[: size * 4 // 5]), np.unique(both)
            agree.append((sign.values(a) == sign.values(b)).mean())
        assert abs(np.mean(agree) - 0.8) < 0.05


def test_small_sets_at_the_similarity_are_possible(spark):
    """Pairs of 4 to 100 shingles at exactly 0.8; in the small ones one value fills many bins."""
    rng, sign = np.random.default_rng(5), neardup.Signatures()
    pairs = []
    for small, large in ((4, 5), (8, 10), (12, 15), (80, 100)):
        for _ in range(500):
            both = rng.integers(0, 1 << 64, large, dtype=np.uint64)
            pairs.append(tuple((len(x), *map(int, sign.buckets(np.sort(x))[1])) for x in (both[:small], both)))
    mark = f"struct<n:bigint,{','.join(f'w{i}:bigint' for i in range(8))}>"
    df = spark.createDataFrame(pairs, f"a {mark}, b {mark}")
    assert df.where(~neardup.possible(80, sign.bins)(F.col("a"), F.col("b"))).count() == 0


def test_links_that_stars_miss_are_found(spark):
    """Members are near each other in pairs only, and one hub is near one of them at most."""
    members = spark.createDataFrame([(7, i, i // 2) for i in [0, *range(2, 90)]], "bucket bigint, id bigint, mark int")
    same = lambda pairs: pairs.where("floor(a / 2) = floor(b / 2)")
    labels = stars.link(members, lambda a, b: F.lit(True), same)
    groups = defaultdict(set)
    for r in labels.collect():
        groups[r.root].add(r.v)
    assert sorted(map(sorted, groups.values())) == [[i, i + 1] for i in range(2, 90, 2)]


def test_links_that_stars_miss_are_found_by_an_exact_join(spark):
    members = spark.createDataFrame([(7, i, i // 2) for i in [0, *range(2, 90)]], "bucket bigint, id bigint, mark int")
    same = lambda pairs: pairs.where("floor(a / 2) = floor(b / 2)")
    exact = lambda apart, others: same(apart.withColumnRenamed("id", "a").join(others.withColumnRenamed("id", "b"), F.floor(F.col("a") / 2) == F.floor(F.col("b") / 2)).where("a <> b"))
    groups = defaultdict(set)
    for r in stars.link(members, lambda a, b: F.lit(True), same, exact).collect():
        groups[r.root].add(r.v)
    assert sorted(map(sorted, groups.values())) == [[i, i + 1] for i in range(2, 90, 2)]


@pytest.mark.parametrize("tries", [(), (1, 4, 16)])
def test_pairs_of_a_large_group_are_linear(spark, monkeypatch, tries):
    """Copies with edits all over: about half of all pairs reach the similarity."""
    rng = random.Random(8)
    base = prose(rng, 160).split()
    n = 240 if not tries else 700
    texts = [edited(rng, base, rng.choice([0, 1, 2, 3, 4, 6, 9])) for _ in range(n)] + [prose(rng, 50) for _ in range(20)]
    made, confirm = [], neardup.confirmed
    monkeypatch.setattr(neardup, "confirmed", lambda pairs, *rest: (made.append(pairs.count()), confirm(pairs, *rest))[1])
    monkeypatch.setattr(neardup, "link", lambda *given: stars.link(*given, tries=tries))
    assert rows(neardup.near_duplicates(frame(spark, texts))) == sorted(near_brute(texts), key=repr)
    if tries:
        assert sum(made) < 80 * n  # n * n / 2 would be 350 * n


def test_members_just_below_the_similarity_make_few_pairs(spark, monkeypatch):
    """A group around one text, most pairs of which lie a little below the similarity: those that
    are near nobody are not compared with the whole group."""
    rng = random.Random(12)
    base = prose(rng, 160).split()
    texts = [" ".join(base)] + [edited(rng, base, 2 + i % 3) for i in range(300)]
    made, cut = [], neardup.cut_lineage
    store = lambda df, name: (out := cut(df, name), made.append(out.count() if name == "pairs" else 0))[0]
    monkeypatch.setattr(neardup, "cut_lineage", store)
    got = rows(neardup.near_duplicates(frame(spark, texts)))
    assert got == sorted(near_brute(texts), key=repr)
    assert 50 < sum(r[0] == r[2] for r in got) and sum(made) < 10 * len(texts)


def python_simhash(hashes):
    return sum(1 << b for b in range(62) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_counts_majorities(spark):
    sets = [["a"], ["a", "b"], list("abcdefg"), [f"w{i}" for i in range(255)], [f"w{i}" for i in range(3000)]]
    df = spark.createDataFrame(list(enumerate(sets)), "row bigint, set array<string>")
    hashes = {r.row: r.h for r in df.select("row", F.transform("set", lambda x: F.xxhash64(x)).alias("h")).collect()}
    got = {r.row: r.fingerprint for r in lines.fingerprints(df).collect()}
    assert got == {k: python_simhash(h) for k, h in hashes.items()}


def levenshtein(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_lines_equal_brute_force(spark):
    rng = random.Random(4)
    bases = [prose(rng, rng.randint(20, 60)) for _ in range(12)]
    docs = []
    for _ in range(40):
        out = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(bases)
            if rng.random() < 0.6:
                line = edited(rng, line.split(), rng.randint(1, 2))
            out.append(line.upper() if rng.random() < 0.2 else line)
        docs.append("\n".join(out + rng.choice([[], [""], [" "]])))
    df = frame(spark, docs)
    seen = lines.occurrences(df, "doc_id", "text").collect()
    norm = lambda o: " ".join(docs[o.id].split("\n")[o.line].lower().split())
    texts, marks = sorted({norm(o) for o in seen}), {norm(o): o.fingerprint for o in seen}
    pairs = []
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            if (marks[a] ^ marks[b]).bit_count() <= 3 and levenshtein(a, b) <= max(len(a), len(b)) * 10 // 100:
                pairs.append((i, j))
    assert len(pairs) > 5
    found = dict(zip(texts, roots(len(texts), pairs)))
    places = defaultdict(list)
    for o in seen:
        places[found[norm(o)]].append((o.id, o.line))
    want = []
    for group in places.values():
        want += [(*p, *min(group), len(group), p == min(group)) for p in group]
    got = lines.group_lines(df)
    assert rows(got) == sorted(want, key=repr)
    cleaned = {r.doc_id: r.text for r in lines.without_repeats(df, got).collect()}
    gone = {(w[0], w[1]) for w in want if not w[5]}
    for i, text in enumerate(docs):
        assert cleaned[i] == "\n".join(x for n, x in enumerate(text.split("\n")) if (i, n) not in gone)


def typed(rng, line, edits):
    for _ in range(edits):
        at, c = rng.randrange(len(line)), rng.choice("etaoinsr")
        line = rng.choice([line[:at] + c + line[at:], line[:at] + line[at + 1 :], line[:at] + c + line[at + 1 :]])
    return " ".join(line.split())


def test_lines_of_one_edit_similarity_are_linked_whatever_their_words(spark):
    """Recall of pairs by edit similarity alone, over lines of 5 to 60 words."""
    rng = random.Random(18)
    bases = [prose(rng, rng.randint(5, 60)) for _ in range(400)]
    others = [
        typed(rng, b, rng.randint(1, max(1, len(b) // 11))) if i % 2 else edited(rng, b.split(), 1) for i, b in enumerate(bases)
    ]
    got = {r.doc_id: r.keep_id for r in lines.group_lines(frame(spark, bases + others), distance=None).collect()}
    near = [i for i, (a, b) in enumerate(zip(bases, others)) if a != b and levenshtein(a, b) <= max(len(a), len(b)) * 10 // 100]
    linked = [i for i in near if got[i + 400] == got[i]]
    print("recall", len(linked), len(near))
    assert len(near) > 300 and len(linked) >= 0.98 * len(near)
    # nothing else is linked
    assert all(got[i] == i for i in range(400)) and all(got[i + 400] in (i, i + 400) for i in range(400))
    assert all(got[i + 400] == i + 400 for i in range(400) if i not in near and bases[i] != others[i])


def test_groups_by_edit_similarity_equal_brute_force(spark):
    rng = random.Random(33)
    bases = [prose(rng, rng.randint(5, 60)) for _ in range(25)]
    docs = []
    for _ in range(60):
        b = rng.choice(bases)
        docs.append("\n".join([typed(rng, b, rng.randint(0, len(b) // 25)), "\t" + rng.choice(bases).upper() + "  "]))
    norm = {(i, n): " ".join(x.lower().split()) for i, d in enumerate(docs) for n, x in enumerate(d.split("\n"))}
    texts = sorted(set(norm.values()))
    alike = lambda a, b: abs(len(a) - len(b)) <= max(len(a), len(b)) // 10 and levenshtein(a, b) <= max(len(a), len(b)) * 10 // 100
    found = dict(zip(texts, roots(len(texts), [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts[:i]) if alike(a, b)])))
    places = defaultdict(list)
    for p, x in norm.items():
        places[found[x]].append(p)
    want = [(*p, *min(g), len(g), p == min(g)) for g in places.values() for p in g]
    assert rows(lines.group_lines(frame(spark, docs), distance=None)) == sorted(want, key=repr)


def test_lines_stand_by_few_pieces(spark, monkeypatch):
    """Long lines have no more pieces than short ones; those that no line of a like length shares are not stored."""
    rng = random.Random(34)
    texts = [prose(rng, n) for n in (8, 30, 60, 200, 600) for _ in range(20)]
    made, cut = {}, lines.cut_lineage
    monkeypatch.setattr(lines, "cut_lineage", lambda df, name: (out := cut(df, name), made.setdefault(name, out.count()))[0])
    got = lines.group_lines(frame(spark, texts), distance=None)
    assert got.count() == len(texts) and got.where("not kept").count() == 0
    # about 70 keys a line were stored, whether shared or not
    assert made["shared-pieces"] < 35 * len(texts)
    measured = lines.measured(frame(spark, texts), "doc_id", "text")
    each = {r.h: r["count"] for r in lines.pieces(measured, 90).groupBy("h").count().collect()}
    assert len(each) == len(texts) and sum(each.values()) < 45 * len(texts) and max(each.values()) < 110


def test_lines_with_one_common_phrase_are_not_compared(spark, monkeypatch):
    """Lines that have one piece in common make no pairs, near ones among them are linked all the same; texts are not kept."""
    rng = random.Random(35)
    texts = []
    for _ in range(300):
        words = prose(rng, rng.randint(45, 50)).split()
        texts.append(" ".join(words[:20] + ["unsubscribe-at-any-time"] + words[20:]))
    near = [typed(rng, x, len(x) // 25) for x in texts[:40]]
    made, cut, folder = [], stars.cut_lineage, shared_dir(spark).removeprefix("file:")
    monkeypatch.setattr(stars, "cut_lineage", lambda df, name: (out := cut(df, name), made.append(out.count() if name == "pairs" else 0))[0])
    before = set(os.listdir(folder))
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    got = {r.doc_id: r.keep_id for r in lines.group_lines(frame(spark, texts + near), distance=None).collect()}
    assert got == {i: i for i in range(300)} | {300 + i: i for i in range(40)}
    # every two of them were compared, or as many as are of a like length
    assert sum(made) < 2 * len(texts)
    assert not [x for x in set(os.listdir(folder)) - before if x.startswith("distinct-lines")]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_pairs_are_ruled_out_and_accepted_as_edit_distance_does(spark):
    rng = random.Random(36)
    bases = [prose(rng, rng.randint(3, 70)) for _ in range(60)]
    pairs = [(x, y) for x in bases for y in (rng.choice(bases), edited(rng, x.split(), 2), typed(rng, x, max(1, len(x) // rng.randint(6, 14))))]
    pairs += [("a" * 150, "b" * 150), ("ab " * 60, "ab " * 66), ("x", "y")]
    rows_ = [(a, b, max(len(a), len(b)) // 10) for a, b in pairs]
    df = spark.createDataFrame(rows_, "a string, b string, room int")
    a, b, room = F.col("a"), F.col("b"), F.col("room")
    found = df.select("*", lines.may_be_near(a, b, room).alias("may"), lines.near_by_words(a, b, room).alias("near")).collect()
    assert len(found) == len(pairs)
    for r in found:
        within = levenshtein(r.a, r.b) <= r.room
        assert (r.may or not within) and (within or not r.near), r
    assert any(not r.may for r in found) and any(r.near for r in found)


def test_marks_and_parts_agree_with_edit_distance(spark):
    """Marks rule out no pair within the room, and parts accept no pair beyond it."""
    rng = random.Random(37)
    bases = [prose(rng, rng.randint(3, 90)) for _ in range(60)]
    pairs = [(x, y) for x in bases for y in (rng.choice(bases), edited(rng, x.split(), 2), typed(rng, x, max(1, len(x) // rng.randint(6, 14))))]
    pairs += [("e" * n, "e" * (n + k)) for n in (20, 130, 300) for k in (0, 1, 13, 14, 30)] + [("é" * 40 + "e", "è" * 40 + "t"), ("ab " * 60, "ab " * 66), ("x", "y")]
    rows_ = [(a, b, max(len(a), len(b)) // 10, len(a), len(b)) for a, b in pairs]
    df = spark.createDataFrame(rows_, "a string, b string, room int, n int, m int")
    mark = lambda text, n: F.struct(F.col(n).alias("n_chars"), *lines.codes_of(F.col(text)))
    df = df.withColumn("x", mark("a", "n")).withColumn("y", mark("b", "m"))
    parts = lines.near_by_parts(F.col("a"), F.col("b"), F.col("room"))
    found = df.select("a", "b", "room", lines.may_be_alike(F.col("x"), F.col("y"), 90).alias("may"), parts.alias("near")).collect()
    assert len(found) == len(pairs)
    for r in found:
        within = levenshtein(r.a, r.b) <= r.room
        assert (r.may or not within) and (within or not r.near), r
    assert any(not r.may for r in found) and any(r.near for r in found)


def test_connected_lines_and_lines_of_other_letters_are_not_compared(spark, monkeypatch):
    """Of a group of near lines few pairs are compared; those of other letters are none, whatever pieces they share."""
    rng = random.Random(38)
    bases = [prose(rng, 50) for _ in range(6)]
    texts = [typed(rng, x, 4) for x in bases for _ in range(20)]
    phrase = "all of these notes begin alike and end so too "
    other = [phrase + rng.choice(letters) * 25 + " " + rng.choice(letters) * 24 for letters in ("ea", "ot", "ni") for _ in range(20)]
    other = list(dict.fromkeys(other))
    made, cut = defaultdict(list), lines.cut_lineage
    monkeypatch.setattr(lines, "cut_lineage", lambda df, name: (out := cut(df, name), made[name].append(out.count()))[0])
    got = {r.doc_id: r.keep_id for r in lines.group_lines(frame(spark, texts + other), distance=None).collect()}
    assert got == {i: i // 20 * 20 for i in range(120)} | {120 + i: 120 + i for i in range(len(other))}
    # all pairs that share pieces were compared before
    assert 1100 < sum(made["sharing-pairs"]) < 1200 and sum(made["best-pairs"]) + made["other-pairs"][-1] < 200


def test_lines_odd(odd, none):
    got = {(r.doc_id, r.line, r.keep_id, r.group_size, r.kept) for r in lines.group_lines(odd).collect()}
    assert {(5, 0, 5, 3, True), (6, 0, 5, 3, False), (3, 0, 3, 2, True), (7, 0, 7, 1, True)} <= got
    assert not {0, 1, 2} & {g[0] for g in got}
    assert lines.group_lines(none).count() == 0
    assert lines.without_repeats(odd, lines.group_lines(odd)).count() == 12
