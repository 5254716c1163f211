"""Secrets in documents, told apart by how many owners and repositories have them.

Only DataFrame functions are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import match_spans, skewed_lookup, text_of
from evenkeel.session import cut_lineage

KINDS = ("assign", "access", "hex", "live")
# Pattern, group that holds the secret, least length of that group. A run of
# hex digits or of a key's letters is matched whole, so that its least length may stand in
# the pattern.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Other strings that may be credentials.
OTHER = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
LEAST_CHARACTERS = 12
#: A value that more owners have is a widely copied example.
MAX_OWNERS = 2
#: So is one in more repositories, be it of one owner.
MAX_REPOS = 10
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|x{4,}|(.)\1{5,}|0123456|1234567|abcdefg"


def candidates(text: Column) -> Column:
    """array of (k, start, end, value): base matches, and other strings of mixed letters and
    digits with many different characters that overlap none of them."""
    base = F.concat(*[_tagged(_long_enough(text, *BASE[kind]), k) for k, kind in enumerate(KINDS[:-1])])
    mixed = lambda v: (
        v.rlike("[0-9]") & v.rlike("[A-Za-z]")
        & (F.size(F.array_distinct(F.split(v, ""))) >= LEAST_CHARACTERS)
    )
    other = F.filter(match_spans(text, OTHER), lambda s: mixed(s["value"]))
    return F.struct(base.alias("base"), _tagged(other, len(KINDS) - 1).alias("other"))


def _long_enough(text: Column, pattern: str, group: int, least: int) -> Column:
    return F.filter(match_spans(text, pattern, group), lambda s: F.char_length(s["value"]) >= least)


def _tagged(spans: Column, k: int) -> Column:
    return F.transform(spans, lambda s: F.struct(
        F.lit(k).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")
    ))


def ownership(uses: DataFrame) -> DataFrame:
    """(value, owners, repos, uses) of ``uses`` (value, owner, repo).

    Three groupings, each combining map-side: a value that a third of all rows share arrives
    as one row per task, owner and repository."""
    each = uses.groupBy("value", "owner", "repo").agg(F.count(F.lit(1)).alias("uses"))
    owned = each.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("uses").alias("uses"))
    return owned.groupBy("value").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("uses").alias("uses")
    )


def scan_secrets(
    docs: DataFrame, owner: Column, repo: Column, id_col: str = "doc_id", text_col: str = "text",
    max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS,
) -> DataFrame:
    """(id, base, added, n_live, n_example), one row per row of ``docs``.

    ``base`` and ``added`` are arrays of (start, k, end, value, owners, repos, live), k being
    the place in KINDS. A candidate's hash is counted over the whole corpus by distinct owner
    and repository: it is live where at most ``max_owners`` owners and ``max_repos`` repositories
    have it and it does not look like a placeholder, and otherwise an example. Base matches always stay, with that mark;
    other strings become spans, of kind live, only where they are live.

    A null text is empty. A null owner or repository counts as one of its own. Repeated rows
    each have a result and count once per owner. An empty table gives an empty result. Other
    columns are not read."""
    rows = docs.select(
        F.col(id_col).alias("id"), owner.alias("owner"), repo.alias("repo"), candidates(text_of(F.col(text_col))).alias("c")
    )
    apart = F.filter("c.other", lambda o: ~F.exists("c.base", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])))
    rows = rows.withColumn("all", F.concat("c.base", apart)).drop("c")
    # a number per row, fixed by storing it: ids may repeat
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()), "candidates")
    uses = rows.select("row", "owner", "repo", F.explode("all").alias("s")).select(
        "row", "owner", "repo", "s.k", "s.start", "s.end", F.col("s.value").alias("text"), F.unhex(F.md5("s.value")).alias("value")
    )
    counts = cut_lineage(ownership(uses), "ownership").withColumn("n", F.col("uses"))
    total = counts.agg(F.sum("uses")).first()[0] or 0
    known = skewed_lookup(uses, counts, ["value"], "n", total, F.col("row"))
    live = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos) & ~F.col("text").rlike(PLACEHOLDER)
    span = F.struct("start", "k", "end", F.col("text").alias("value"), "owners", "repos", live.alias("live"))
    base = F.col("k") < len(KINDS) - 1
    per_row = known.withColumn("s", span).groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(base, F.col("s")))).alias("base"),
        F.array_sort(F.collect_list(F.when(~base & live, F.col("s")))).alias("added"),
        F.sum((base & live).cast("bigint")).alias("n_live"), F.sum((base & ~live).cast("bigint")).alias("n_example"),
    )
    none = F.array().cast(per_row.schema["base"].dataType)
    out = rows.select("row", "id").join(per_row, "row", "left")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )
