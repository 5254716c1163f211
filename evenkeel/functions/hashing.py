"""Reproducible pseudo-random numbers.

All sampling, splitting and drawing is ordered by an md5 prefix of the row id and a
seed, so a result never depends on partitioning, task retries or row order, and any
engine with md5 reproduces it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_HEX_DIGITS = 13
HASH_BITS = 4 * HASH_HEX_DIGITS
HASH_RANGE = 1 << HASH_BITS


def hash52(*parts: Column | str | int) -> Column:
    """Unsigned 52-bit hash (as bigint, exact in a double) of the parts joined by ':'.

    Columns are passed as ``Column``; plain strings and numbers are literals."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(
        F.substring(F.md5(F.concat_ws(":", *cols)), 1, HASH_HEX_DIGITS), 16, 10
    ).cast("bigint")


def unit_hash(*parts: Column | str | int) -> Column:
    """Uniform double in [0, 1) derived from :func:`hash52`."""
    return hash52(*parts).cast("double") / F.lit(float(HASH_RANGE))


def hash_bucket(h: Column, buckets: int) -> Column:
    """Order-preserving bucket 0..buckets-1 of a 52-bit hash (buckets below 2**16)."""
    top = F.shiftright(h, HASH_BITS - 32)
    return F.shiftright(top * F.lit(buckets).cast("bigint"), 32).cast("int")
