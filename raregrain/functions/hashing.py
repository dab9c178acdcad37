"""Portable hash key: the same number in Spark and in any engine with md5.

Sampling and splitting use it in place of ``rand()``, so a row's fate depends on
its key and the seed only, never on partitioning, task retries or row order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 32
HASH_SPACE = 1 << HASH_BITS


def hash_key(key: str | Column, seed: int) -> Column:
    """First 32 bits of ``md5("<key>:<seed>")`` as a non-negative bigint."""
    key = F.col(key) if isinstance(key, str) else key
    salted = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(salted.cast("binary")), 1, 8), 16, 10).cast("bigint")


def hash_bucket(key: str | Column, seed: int, buckets: int) -> Column:
    """Hash key modulo ``buckets``."""
    return F.pmod(hash_key(key, seed), F.lit(buckets).cast("bigint"))


def hash_fraction_below(key: str | Column, seed: int, fraction: float | Column) -> Column:
    """True for a ``fraction`` of all keys."""
    bound = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return hash_key(key, seed).cast("double") < bound * F.lit(float(HASH_SPACE))
