"""Benchmark passages in documents, found with a positional inverted index.

Only DataFrame functions are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import ascii_lower
from evenkeel.operators.sizing import broadcast_if_small
from evenkeel.session import cut_lineage

WINDOW = 13
RARE = 2
#: A word moved to anywhere in its window is within so many words of its place.
SLOP = WINDOW - 1
# Fixed value: what separates words (all ASCII but digits and lower-case letters).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def item_words(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, words, n, name) of all items that have words, equal rows once. ``item`` numbers
    the rows, as one id, kept in ``name``, may have several, and is fixed by storing it."""
    rows = items.select(F.col(item_col).alias("name"), words_of(F.col(text_col)).alias("words"))
    rows = rows.withColumn("n", F.size("words")).where("n > 0").distinct()
    return cut_lineage(rows.select(F.monotonically_increasing_id().alias("item"), "words", "n", "name"), "items")


def positional_index(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Postings (id, n_words, term, pos) of the documents (id, text), for the terms of
    ``items`` (item, words, n). Other terms cannot be part of a match and are left out, but for
    each document's first word, with a null term if need be, which carries ``n_words``."""
    terms = items.select(F.explode("words").alias("w")).select(F.xxhash64("w").alias("term")).distinct()
    terms = broadcast_if_small(terms.withColumn("known", F.lit(True)))
    rows = docs.select("id", words_of(F.col("text")).alias("words"))
    rows = rows.select("id", F.size("words").alias("n_words"), F.posexplode("words").alias("pos", "w"))
    rows = rows.withColumn("term", F.xxhash64("w")).drop("w").join(terms, "term", "left")
    rows = rows.where("known or pos = 0")
    return rows.select("id", "n_words", F.when(F.col("known"), F.col("term")).alias("term"), "pos")


def rarest_terms(items: DataFrame, index: DataFrame, window: int, rare: int) -> DataFrame:
    """(item, segment, term, q, k, need): the ``rare`` terms of each segment that the corpus
    has least often, at position q of the item.

    Items are cut into segments of half a window, (window + 1) // 2 words: every window
    contains one whole segment, so a match must match all words of some segment. Segments with
    a term that the corpus lacks cannot match and are left out."""
    size = (window + 1) // 2
    counts = index.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    at = items.select("item", "n", F.posexplode("words").alias("q", "w")).withColumn("term", F.xxhash64("w"))
    at = at.withColumn("segment", F.floor(F.col("q") / size))
    whole = (F.col("segment") == 0) | ((F.col("segment") + 1) * size <= F.col("n"))
    at = at.where(whole).join(counts, "term", "left").fillna(0, ["freq"])
    per = Window.partitionBy("item", "segment")
    ranked = at.withColumns({
        "k": F.row_number().over(per.orderBy("freq", "q")) - 1, "least": F.min("freq").over(per), "words": F.count(F.lit(1)).over(per),
    })
    need = F.least(F.col("words"), F.lit(rare))
    return ranked.where((F.col("least") > 0) & (F.col("k") < rare)).select("item", "segment", "term", "q", "k", need.cast("int").alias("need"))


def postings(index: DataFrame, rarest: DataFrame) -> DataFrame:
    """(id, item, segment, k, need, diagonal): the postings of the rarest terms, moved by
    their position in the item. On one diagonal, document and item run side by side."""
    found = index.where("term is not null").join(broadcast_if_small(rarest), "term")
    return found.select("id", "item", "segment", "k", "need", (F.col("pos") - F.col("q")).alias("diagonal"))


def alignments(index: DataFrame, rarest: DataFrame) -> DataFrame:
    """(id, item, diagonal) where all the rarest terms of a segment stand as in the item."""
    lists = postings(index, rarest).groupBy("id", "item", "segment", "diagonal", "need")
    both = lists.agg(F.bit_or(F.expr("shiftleft(1, k)")).alias("seen"))
    return both.where("seen = shiftleft(1, need) - 1").select("id", "item", "diagonal").distinct()


def proximity_cells(index: DataFrame, rarest: DataFrame, slop: int) -> DataFrame:
    """(id, item, segment, c): the segment's rarest terms all stand within ``slop`` words of
    their places in the item, in any order, in the cell ``c`` (grid, cell) of diagonals.

    Diagonals are dealt to cells of two overlapping grids, one of which holds any two that are
    within ``slop``; a cell has at most 2 * slop + 2 diagonals for each term."""
    cells = postings(index, rarest).select("id", "item", "segment", "k", "need", "diagonal", F.explode(cells_of(F.col("diagonal"), slop)).alias("c"))
    lists = cells.groupBy("id", "item", "segment", "need", "c").agg(F.collect_set(F.struct("k", "diagonal")).alias("seen"))
    near = F.exists("seen", lambda x: F.size(F.array_distinct(F.transform(
        F.filter("seen", lambda y: (y["diagonal"] >= x["diagonal"]) & (y["diagonal"] <= x["diagonal"] + slop)), lambda y: y["k"]
    ))) == F.col("need"))
    return lists.where(near).select("id", "item", "segment", "c").distinct()


def cells_of(diagonal: Column, slop: int) -> Column:
    width = 2 * slop + 2
    return F.array(*[F.struct(F.lit(g).alias("grid"), F.floor((diagonal + s) / width).alias("cell")) for g, s in enumerate((0, slop + 1))])


def proximity_matches(index: DataFrame, rarest: DataFrame, slop: int) -> DataFrame:
    """(id, item, segment) of :func:`proximity_cells`."""
    return proximity_cells(index, rarest, slop).select("id", "item", "segment").distinct()


def near_windows(index: DataFrame, items: DataFrame, cells: DataFrame, window: int, slop: int) -> DataFrame:
    """(id, item) where all words of a window of the item stand within ``slop`` words of their
    places, in any order. ``cells``, a stored table, has where the rarest terms of a segment do."""
    at = items.select("item", "n", F.posexplode("words").alias("q", "w")).select("item", "n", "q", F.xxhash64("w").alias("term"))
    wanted = cells.select("id", "item", "c").distinct().join(broadcast_if_small(at), "item")
    found = wanted.join(index.where("term is not null").select("id", "term", "pos"), ["id", "term"])
    found = found.withColumn("diagonal", F.col("pos") - F.col("q")).where(F.array_contains(cells_of(F.col("diagonal"), slop), F.col("c")))
    lists = found.groupBy("id", "item", "n", "c").agg(F.collect_set(F.struct("q", "diagonal")).alias("seen"))

    def whole(low: Column) -> Column:
        there = F.transform(F.filter("seen", lambda y: y["diagonal"].between(low, low + slop)), lambda y: y["q"])
        mask = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when(F.array_contains(there, i), "1").otherwise("0")), "")
        return F.contains(mask, F.repeat(F.lit("1"), F.least(F.col("n"), F.lit(window))))

    starts = F.array_distinct(F.transform("seen", lambda x: x["diagonal"]))
    return lists.where(F.exists(starts, whole)).select("id", "item").distinct()


def runs(mask: Column, length: int) -> Column:
    """array<struct<at, n>> of the runs of at least ``length`` ones in a string of 0 and 1."""
    pattern = f"1{{{length},}}"
    found = F.regexp_extract_all(mask, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(mask, pattern, -1)
    width = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda a, x: a + F.char_length(x))
    at = lambda x, i: F.struct((width(gaps, i + 1) + width(found, i)).alias("at"), F.char_length(x).alias("n"))
    return F.transform(found, at)


def exact_matches(docs: DataFrame, items: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """(id, item, at, n): runs of words of a document that are covered by windows of the item,
    for the alignments ``found``, a stored table."""
    sides = found.join(broadcast_if_small(items), "item")
    per_doc = sides.groupBy("id").agg(F.collect_list(F.struct("item", "diagonal", "words", "n")).alias("sides"))
    ids = broadcast_if_small(found.select("id").distinct())
    texts = docs.join(ids, "id", "left_semi").join(per_doc, "id")
    words = texts.select("id", words_of(F.col("text")).alias("doc"), "sides")

    def compare(side: Column) -> Column:
        begin, skip = F.greatest(side["diagonal"], F.lit(0)), F.greatest(-side["diagonal"], F.lit(0))
        n = F.greatest(F.least(side["n"] - skip, F.size("doc") - begin), F.lit(0))
        same = F.zip_with(F.slice("doc", begin + 1, n), F.slice(side["words"], skip + 1, n), lambda a, b: F.when(a == b, "1").otherwise("0"))
        return F.struct(side["item"].alias("item"), side["n"].alias("size"), begin.alias("begin"), F.array_join(same, "").alias("mask"))

    masks = words.select("id", F.explode(F.transform("sides", compare)).alias("m")).select("id", "m.*")
    whole = F.when(F.col("mask") == F.expr("repeat('1', size)"), F.array(F.struct(F.lit(0).alias("at"), F.col("size").alias("n"))))
    spans = F.when(F.col("size") >= window, runs(F.col("mask"), window)).otherwise(whole)
    out = masks.select("id", "item", "begin", F.explode(spans).alias("s"))
    return out.select("id", "item", (F.col("begin") + F.col("s.at")).alias("at"), F.col("s.n").alias("n")).distinct()


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, rare: int = RARE,
    slop: int | None = SLOP,
) -> DataFrame:
    """(id, n_words, n_hit, items, near_items), one row per row of ``docs``.

    Words are runs of digits, lower-cased letters a-z and characters beyond ASCII. A window is
    ``window`` consecutive words of an item, or all of a shorter one; a document's word is hit
    inside any occurrence of a window; ``items`` are the sorted ids, as strings, of items with
    an occurring window. ``near_items`` are those with a window whose words all occur within
    ``slop`` words of their places, in any order, so that words may be put between or moved; a
    word's place is counted from the window's place in the document. It has all of ``items``
    and does not count in n_hit. Without ``slop`` they are not looked for, and the column is left out.

    Null texts have no words. Rows of one id are one document, of the most words and all hits;
    each row without an id is a document of its own.
    Items without words match nothing; items of one id are one item with all their windows, and
    so are those without id, whose name is empty.
    Where either table is empty nothing is hit. Other columns are not read."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lone = rows.where("id is null")
    tests = item_words(items, item_col, item_text_col)
    found = contamination(rows.where("id is not null"), tests, window, rare, slop)
    if lone.limit(1).count():
        # equal texts have equal results, so the text's digest may stand for the missing id
        named = lone.select(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("id"), "text")
        own = contamination(named, tests, window, rare, slop)
        found = found.unionByName(own.withColumn("id", F.lit(None).cast(rows.schema["id"].dataType)))
    return found.withColumnRenamed("id", id_col)


def contamination(rows: DataFrame, tests: DataFrame, window: int, rare: int, slop: int | None) -> DataFrame:
    """:func:`find_contamination` of rows (id, text) with ids, for the items of :func:`item_words`."""
    index = cut_lineage(positional_index(rows, tests), "postings")
    rarest = cut_lineage(rarest_terms(tests, index, window, rare), "rarest-terms")
    found = cut_lineage(alignments(index, rarest), "alignments")
    exact = exact_matches(rows, tests, found, window)
    names = tests.select("item", F.coalesce(F.col("name").cast("string"), F.lit("")).alias("name"))
    exact = exact.join(broadcast_if_small(names), "item")
    places = F.array_distinct(F.flatten(F.transform(F.collect_list(F.struct("at", "n")), lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))
    hits = exact.groupBy("id").agg(
        F.size(places).cast("bigint").alias("n_hit"),
        F.sort_array(F.collect_set("name")).alias("items"),
    )
    sides = [hits]
    if slop is not None:
        cells = cut_lineage(proximity_cells(index, rarest, slop), "proximity-cells")
        near = near_windows(index, tests, cells, window, slop).join(broadcast_if_small(names), "item")
        sides.append(near.groupBy("id").agg(F.sort_array(F.collect_set("name")).alias("near_items")))
    sizes = index.where("pos = 0").groupBy("id").agg(F.max("n_words").cast("bigint").alias("n_words"))
    out = rows.select("id")
    for i, side in enumerate((sizes, *sides)):
        out = out.join(side.withColumnRenamed("id", f"id{i}"), F.col("id").eqNullSafe(F.col(f"id{i}")), "left").drop(f"id{i}")
    lists = ["items"] if slop is None else ["items", "near_items"]
    return out.select(
        "id", F.coalesce("n_words", F.lit(0).cast("bigint")).alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in lists],
    )


def contaminated() -> Column:
    """At least a twentieth of the words, and at least one, is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
