"""Structured dataset names: ``con<n>_<dir>_<con>.._cX###_c1y###.._Xy###[_suffix]``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Transform = Callable[[Column], Column]


def _dashed(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit("-"))


def _pct(c: Column, effect_mul: Transform) -> Column:
    """Three-digit zero-padded integer part."""
    n = effect_mul(c).cast("bigint").cast("string")
    return F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)


def pack_name(
    direct: Column,
    cons: Column,
    cX: Column,
    cys: Column,
    Xy: Column,
    suffix: Column | None = None,
    effect_mul: Transform = lambda e: e,
) -> Column:
    """Build a name; ``cons`` and ``cys`` are arrays of equal length."""
    head = F.concat(
        F.lit("con"), F.size(cons).cast("string"), F.lit("_"), _dashed(direct),
        F.array_join(F.transform(cons, lambda c: F.concat(F.lit("_"), _dashed(c))), ""),
    )
    cy = F.array_join(
        F.transform(
            cys,
            lambda v, i: F.concat(
                F.lit("_c"), (i + 1).cast("string"), F.lit("y"), _pct(v, effect_mul)
            ),
        ),
        "",
    )
    name = F.concat(
        head, F.lit("_cX"), _pct(cX, effect_mul), cy, F.lit("_Xy"), _pct(Xy, effect_mul)
    )
    if suffix is None:
        return name
    return F.when(suffix == "", name).otherwise(F.concat(name, F.lit("_"), suffix))


def unpack_name(name: Column, effect_mul: float = 1, prefix: str | None = None) -> Column:
    """Parse a name into struct(n, direct, cons, cX, cys, Xy, suffix).

    ``prefix`` is an optional regular expression stripped from the front. The direct
    latent's last dash becomes an underscore; a confounder's every dash does."""
    body = F.regexp_replace(name, "^" + prefix, "") if prefix else name
    parts = F.split(body, "_")
    n = F.regexp_extract(F.element_at(parts, 1), r"^con(\d+)$", 1).try_cast("int")

    def num(part: Column, key: str) -> Column:
        return F.regexp_extract(part, key + r"(\d+)$", 1).try_cast("double") / float(effect_mul)

    def at(i: Column) -> Column:
        return F.try_element_at(parts, i)

    cys = F.transform(F.slice(parts, n + 4, n), lambda p: num(p, r"^c\d+y"))
    return F.struct(
        n.cast("bigint").alias("n"),
        F.regexp_replace(at(F.lit(2)), r"-([^-]*)$", "_$1").alias("direct"),
        F.transform(
            F.slice(parts, F.lit(3), n), lambda p: F.replace(p, F.lit("-"), F.lit("_"))
        ).alias("cons"),
        num(at(n + 3), "^cX").alias("cX"),
        cys.alias("cys"),
        num(at(n * 2 + 4), "^Xy").alias("Xy"),
        F.coalesce(at(n * 2 + 5), F.lit("")).alias("suffix"),
        # Names with leftover parts are malformed.
        (F.size(parts) <= n * 2 + 5).alias("valid"),
    )


def family(name: Column) -> Column:
    """The name with its effect sizes masked."""
    return F.regexp_replace(name, r"(cX|c\d*y|Xy)\d+", "$1***")


def effects_only(name: Column) -> Column:
    """The name from its first effect key onwards."""
    return F.regexp_replace(name, r"^.*?_?(?=cX\d)", "")


def effect_position(cX: Column, cy: Column, Xy: Column) -> Column:
    """Single sort value ordering by Xy, then cy, then cX."""
    return Xy + cy / 100.0 + cX / 10000.0
