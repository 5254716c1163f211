"""The corpus operators as named queries over the test tables, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.catalog.registry import h, u
from evenkeel.llm import decontaminate, exact, language, lines, merkle, mixing, neardup, pii, quality, secrets, sharding, tokens, trie
from evenkeel.llm.common import listed, word_count
from evenkeel.session import cut_lineage, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SHARDS = 16
CYCLE = (1, 2, 3)
SEED = 5


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("op10_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op10_exact_dedup(spark, d):
    out = exact.exact_dedup(table(spark, d, "documents"), keep="max")
    return out.withColumnRenamed("digest", "text_sha256")


@query("op5_mix_sources", f"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0
         ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM per),
-- sources are capped in order of room per weight, as long as the next one's level exceeds its room
ordered AS (
  SELECT *, 3.0 * source_size / weight AS ratio,
         (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))::DOUBLE
           / sum(weight) OVER rest AS level
  FROM ranked
  WINDOW before AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
cut AS (SELECT arg_min(level, ratio) FILTER (level <= ratio) AS level FROM ordered),
goal AS (SELECT source, source_size, least(cut.level * weight, 3.0 * source_size)::DOUBLE AS exact, round(exact, 6) AS target FROM ordered, cut),
rated AS (
  SELECT doc_id, sized.source, size, source_size, target, {h("coalesce(doc_id::VARCHAR, '')", str(SEED))} AS h,
         CASE WHEN source_size = 0 THEN 0 ELSE least(exact / source_size, 3) END AS rate,
         h % greatest(ceil(count(*) OVER (PARTITION BY sized.source) / {mixing.DRAWN_TOGETHER}), 1)::BIGINT AS salt
  FROM sized JOIN goal ON sized.source IS NOT DISTINCT FROM goal.source),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source, salt ORDER BY size, h, doc_id) AS k,
         {u("coalesce(source, '')", "salt", str(SEED))} AS u, rate - floor(rate) AS part FROM rated)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (floor(rate) + floor(part * k + u) - floor(part * (k - 1) + u)))::BIGINT AS taken
FROM placed""")
def op5_mix_sources(spark, d):
    docs = table(spark, d, "documents")
    sized = cut_lineage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "word-counts")
    mixed = mixing.mix(sized, CYCLE, "source", "size", ["doc_id"], seed=SEED)
    return mixed.select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"),
        (F.col("size") * F.col("copies")).alias("taken"),
    )


@query("op7_shards")
def op7_shards(spark, d):
    out = sharding.shard_rows(table(spark, d, "documents"), shards=SHARDS)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op9_language")
def op9_language(spark, d):
    docs = table(spark, d, "documents")
    model = language.fit(docs, ~language.held_out("doc_id"))
    out = language.identify(docs, model)
    return out.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score", "mixture")


@query("op3_near_dedup", """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS s
  FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b USING (s)
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (
  SELECT doc_id AS v, doc_id AS r FROM documents
  UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.v)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.v = d.doc_id GROUP BY d.doc_id""")
def op3_near_dedup(spark, d):
    return neardup.near_duplicates(table(spark, d, "documents"), shingle=4)


@query("op6_decontaminate", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, unnest([array_to_string(w[i:i + least(13, len(w)) - 1], ' ')
         FOR i IN range(1, greatest(len(w) - 12, 1) + 1)]) AS s FROM b WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM w, lengths WHERE len(w) >= n),
met AS (SELECT doc_id, item_id, i, n FROM grams JOIN windows USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op6_decontaminate(spark, d):
    out = decontaminate.find_contamination(table(spark, d, "documents"), table(spark, d, "benchmark"), slop=None)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


@query("op6_proximity")
def op6_proximity(spark, d):
    # op6_decontaminate has the columns of its SQL only
    out = decontaminate.find_contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
        F.size("near_items").cast("bigint").alias("n_near_items"), F.array_join("near_items", ",").alias("near_items"),
    )


@query("op1_secret_scan")
def op1_secret_scan(spark, d):
    # documents name a source only: it stands for the owner, and each of its texts for a repository,
    # so that exact copies count once
    found = secrets.scan_secrets(table(spark, d, "documents"), F.col("source"), F.md5("text"))
    short = lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["k"], s["end"]))
    of = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("bigint")
    return found.select(
        "doc_id", *[of(k).alias(f"n_{kind}") for k, kind in enumerate(secrets.KINDS[:-1])],
        F.sha2(listed(short("base"), secrets.KINDS), 256).alias("base_sha256"),
        listed(F.concat(short("base"), short("added")), secrets.KINDS).alias("spans"),
        F.size("added").cast("bigint").alias("n_added"), "n_live", "n_example",
    )


@query("op2_pii")
def op2_pii(spark, d):
    docs = table(spark, d, "documents")
    model = pii.fit(docs.select(F.col("doc_id").alias("id"), "text"))
    found = pii.scan_personal(docs, model)
    base = F.filter("spans", lambda s: s["base"])
    short = lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["k"], s["end"]))
    of = lambda k: F.size(F.filter(base, lambda s: s["k"] == k)).cast("bigint")
    return found.select(
        "doc_id", *[of(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)],
        F.sha2(listed(short(base), pii.KINDS), 256).alias("base_sha256"),
        listed(short(F.col("spans")), pii.KINDS).alias("spans"),
        (F.size("spans") - F.size(base)).cast("bigint").alias("n_added"),
    )


@query("op4_token_blocks")
def op4_token_blocks(spark, d):
    folder = scratch_path(spark, "tokens")
    files = tokens.write_tokens(table(spark, d, "documents"), folder, tokens.default_vocabulary())
    return tokens.read_documents(files, folder)


@query("op8_fuzzy_lines")
def op8_fuzzy_lines(spark, d):
    return lines.group_lines(table(spark, d, "documents"), distance=None)


def _framed(*fields: str) -> str:
    each = [f"coalesce(strlen(({f})::VARCHAR)::VARCHAR || ':' || ({f})::VARCHAR, '-')" for f in fields]
    return f"sha256({' || '.join(each)})"


def _crc32(number: str) -> str:
    """Unsigned CRC-32 of a number's decimal text: each byte, then eight steps of one bit."""
    steps = f"flatten([[ord(x), -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(({number})::VARCHAR, '')])"
    step = "CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END"
    return f"xor(list_reduce([y::BIGINT for y in {steps}], lambda c, x: {step}, 4294967295::BIGINT), 4294967295)"


# a tree's nodes level by level (lvl, pos, h; n of the level), a node's sibling being its neighbour
_TREE = """SELECT g, 0 AS lvl, pos, n, h FROM {leaves}
  UNION ALL
  SELECT g, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {tree} WHERE n > 1 GROUP BY g, lvl, pos // 2, n"""


@query("op13_merkle", f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang AS g, {_framed("doc_id", "source", "lang", "n_chars", "text")} AS h,
         {_framed("doc_id", "source", "lang", "n_chars + 1", "text")} AS changed,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM documents),
tree AS ({_TREE.format(leaves="leaves", tree="tree")}),
tops AS (SELECT 0 AS g, g AS lang, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
head AS ({_TREE.format(leaves="tops", tree="head")}),
whole AS (SELECT h AS root FROM head WHERE n = 1),
-- the way up: first in the language's tree, then in that of the subroots
climb AS (
  SELECT doc_id, g, false AS up, 0 AS lvl, pos, n, '' AS proof,
         CASE WHEN {_crc32("doc_id")} % 7 = 0 AND n_chars IS NOT NULL THEN changed ELSE h END AS folded
  FROM leaves JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id)
  UNION ALL
  SELECT c.doc_id, c.g, c.up OR c.n = 1,
         CASE WHEN c.n > 1 THEN c.lvl + 1 ELSE 0 END, CASE WHEN c.n > 1 THEN c.pos // 2 ELSE t.pos END,
         CASE WHEN c.n > 1 THEN (c.n + 1) // 2 ELSE t.n END,
         c.proof || CASE WHEN c.n > 1 THEN coalesce(s.h, x.h, '') ELSE '' END,
         CASE WHEN c.n = 1 THEN c.folded WHEN c.pos % 2 = 0 THEN sha256(c.folded || coalesce(s.h, x.h, ''))
              ELSE sha256(coalesce(s.h, x.h) || c.folded) END
  FROM climb c
  LEFT JOIN tree s ON NOT c.up AND c.n > 1 AND s.g IS NOT DISTINCT FROM c.g AND s.lvl = c.lvl AND s.pos = xor(c.pos, 1)
  LEFT JOIN head x ON c.up AND c.n > 1 AND x.lvl = c.lvl AND x.pos = xor(c.pos, 1)
  LEFT JOIN tops t ON t.lang IS NOT DISTINCT FROM c.g
  WHERE c.n > 1 OR NOT c.up)
SELECT l.doc_id, l.h AS leaf, t.h AS subroot, root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = root AS verified
FROM leaves l JOIN climb c ON c.doc_id = l.doc_id AND c.up AND c.n = 1 JOIN tops t ON t.lang IS NOT DISTINCT FROM l.g, whole""")
def op13_merkle(spark, d):
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = merkle.manifest(table(spark, d, "documents"), {"n_chars": F.col("n_chars") + 1}, struck)
    return out.select(
        "doc_id", "leaf", "subroot", "root", merkle.digest_of(merkle.proof_text(F.col("path"))).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query("op12_prefix_trie", f"""
WITH said AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT c, md5(strlen(role)::VARCHAR || ':' || role || text) AS turn_key, strlen(text) AS bytes,
         row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(strlen(role)::VARCHAR || ':' || role || text)) AS at FROM said),
own AS (SELECT c, count(*) AS n, {_crc32("c")} % 9 AS h, c - c % 5 AS base FROM turns GROUP BY c),
convs AS (SELECT k.*, least(coalesce(b.n, 0), k.h) AS taken, least(coalesce(b.n, 0), k.h) + greatest(k.n - k.h, 0) AS length
          FROM own k LEFT JOIN own b ON b.c = k.base),
built AS (
  SELECT k.c, t.at AS i, turn_key, bytes, length FROM convs k JOIN turns t ON t.c = k.base AND t.at <= k.h
  UNION ALL SELECT k.c, taken + t.at - h, turn_key, bytes, length FROM convs k JOIN turns t ON t.c = k.c AND t.at > k.h),
starts AS (
  SELECT c, i AS depth, string_agg(turn_key, '') OVER (PARTITION BY c ORDER BY i) AS key, bytes, length FROM built
  UNION ALL SELECT c, 0, '', 0, length FROM convs),
nodes AS (
  SELECT key, min(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (length = depth), '')) AS ends_sha256
  FROM starts GROUP BY key),
kids AS (SELECT key[:len(key) - 32] AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
up AS (SELECT nodes.*, unnest(range(0, depth + 1)) AS d FROM nodes),
sums AS (
  SELECT up.key[:32 * d] AS key, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
  FROM up LEFT JOIN kids k ON k.key = up.key GROUP BY 1)
SELECT a.conv_id, a.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, a.n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, a.ends_sha256
FROM nodes a JOIN sums USING (key) LEFT JOIN kids k USING (key)
LEFT JOIN nodes p ON a.depth > 0 AND p.key = a.key[:len(a.key) - 32]""")
def op12_prefix_trie(spark, d):
    return trie.prefix_trie(table(spark, d, "conversations"))


@query("op11_quality")
def op11_quality(spark, d):
    docs = table(spark, d, "documents")
    model = quality.fit(docs, table(spark, d, "labels"), ~language.held_out("doc_id"))
    out = quality.score(docs, model)
    return out.select(
        "doc_id", language.held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )
