"""String helpers: padded ids, tagged values, display labels, stringified lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_id(col: Column, width: int = 5) -> Column:
    """Zero-padded id; longer ids keep all their digits."""
    s = col.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def parse_list(col: Column) -> Column:
    """Stringified list of numbers to array<double>; malformed text gives null."""
    return F.from_json(col, "array<double>")


def tag_ordinal(col: Column) -> Column:
    """Leading number of a tagged value such as ``2-lightsalmon``."""
    return F.split(col, "-", 2)[0].try_cast("int")


def tag_name(col: Column) -> Column:
    return F.split(col, "-", 2)[1]


def basename(col: Column) -> Column:
    """Last path component, ignoring trailing slashes."""
    return F.substring_index(F.rtrim(col, F.lit("/")), "/", -1)


def replace_chain(col: Column, replacements: Iterable[tuple[str, str]], suffix: str = "") -> Column:
    """Apply literal replacements in order, then append ``suffix``."""
    for old, new in replacements:
        col = F.replace(col, F.lit(old), F.lit(new))
    return F.concat(col, F.lit(suffix)) if suffix else col


# Display symbols for variable-name prefixes (fixed values).
PREFIX_SYMBOLS = (("_", "-"), ("attr-", "$L_{"), ("lbl-", "$y_{"), ("cov-", "$C_{"))


def symbol_label(col: Column) -> Column:
    """Variable name to its display symbol."""
    return replace_chain(col, PREFIX_SYMBOLS, "}$")
