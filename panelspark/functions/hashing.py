"""Reproducible pseudo-random order from md5, identical on any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BUCKETS = 16**4


def order_hash(*parts: Column, seed: int | str = 42) -> Column:
    return F.md5(F.concat_ws("~", *[p.cast("string") for p in parts], F.lit(str(seed))))


def hash_bucket(h: Column) -> Column:
    """Order-preserving bucket: the leading four hex digits."""
    return F.conv(F.substring(h, 1, 4), 16, 10).cast("int")


def hash_long(h: Column) -> Column:
    """A non-negative 60-bit integer from the leading fifteen hex digits."""
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")


def hash_unit(h: Column) -> Column:
    """A number in [0, 1) from the leading eight hex digits."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(16**8)
