"""Reproducible pseudo-random numbers from row keys.

Every random choice in this package (folds, splits, bags, noise) is a function of a row key and a seed.  A lost
executor therefore recomputes the same rows, the result does not depend on partitioning, and any SQL engine with
``md5`` can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 4294967296  # 2**32: the first 8 hex digits of an md5 digest


def key_digest(key: Column, seed) -> Column:
    """md5 of ``key:seed`` as 32 hex digits; ordering by it is a seeded shuffle of the keys."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))


def hash32(key: Column, seed) -> Column:
    """Unsigned 32-bit hash of the key as BIGINT."""
    return F.conv(F.substring(key_digest(key, seed), 1, 8), 16, 10).cast("bigint")


def hash_unit(key: Column, seed) -> Column:
    """Uniform number in [0, 1) that depends only on key and seed."""
    return hash32(key, seed) / F.lit(float(HASH_RANGE))
