"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key with more than 1/HOT of all rows is hot, so that there are at most HOT hot keys.
HOT = 1000
SALTS = 997
# White space and words of the corpus contracts.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Only A-Z changes, whatever the locale. Pure ASCII texts take the faster way."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_of(text: Column) -> Column:
    """Null counts as empty."""
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def skewed_lookup(
    left: DataFrame, right: DataFrame, keys: Sequence[str], n: str, total: int, spread: Column
) -> DataFrame:
    """Left join of ``right`` (one row per key; nulls are keys too), whose column ``n`` has
    the number of rows of ``left`` with that key, of ``total``.

    Keys with at least 1/HOT of all rows, of which there are at most HOT, are broadcast; all
    others join by a shuffle, where the rows of hot keys are dealt out by ``spread`` as they
    need no partner there. ``n`` itself is not returned. Read ``right`` from storage, as it
    is used twice."""
    values = [c for c in right.columns if c not in {*keys, n}]
    side = lambda rows, name: rows.select(
        *[F.col(k).alias(f"{name}_{k}") for k in keys], F.struct(*values).alias(name)
    )
    hot = side(right.where(F.col(n) * HOT >= F.lit(total)), "__hot")
    cold = side(right.where(F.col(n) * HOT < F.lit(total)), "__cold")
    match = lambda name: [F.col(k).eqNullSafe(F.col(f"{name}_{k}")) for k in keys]
    out = left.join(F.broadcast(hot), match("__hot"), "left")
    salt = F.when(F.col("__hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    out = out.withColumn("__salt", salt.cast("int")).join(
        cold.withColumn("__cold_salt", F.lit(0)),
        [*match("__cold"), F.col("__salt") == F.col("__cold_salt")],
        "left",
    )
    found = F.coalesce("__hot", "__cold")
    return out.select(*[F.col(c) for c in left.columns], *[found[c].alias(c) for c in values])


def running_total(df: DataFrame, n: str, order: Sequence[str], out: str) -> DataFrame:
    """Sum of ``n`` over all rows before this one. For short tables only: one row per file,
    partition or bucket."""
    w = Window.orderBy(*order)
    return df.withColumn(out, F.sum(n).over(w) - F.col(n))


SPAN = "struct<start:bigint,end:bigint,value:string>"


def match_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array of (start, end, value) of the pattern's leftmost non-overlapping matches, in code
    points, end exclusive; ``value`` is what ``group`` matched. The pattern must not match
    nothing.

    Texts without a match cost one search. In others the pieces between matches give the
    positions."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(whole))
    steps = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["gap"])
        end = begin + F.char_length(x["whole"])
        span = F.struct(begin.cast("bigint").alias("start"), end.cast("bigint").alias("end"), x["value"].alias("value"))
        return F.struct(end.cast("bigint").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    found = F.aggregate(steps, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def listed(spans: Column, kinds: Sequence[str]) -> Column:
    """'kind:start:end,..' of an array of (start, k, end), by start, then kind."""
    names = F.array(*[F.lit(k) for k in kinds])
    shown = lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), shown), ",")
