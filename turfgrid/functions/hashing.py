"""Keyed pseudo-random numbers that do not depend on partitioning, order or retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 48


def keyed_hash(seed: int, *keys: Column) -> Column:
    """48 hash bits of the seed and keys, as a non-negative bigint."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def keyed_uniform(seed: int, *keys: Column) -> Column:
    """Uniform number strictly between 0 and 1."""
    return (keyed_hash(seed, *keys).cast("double") + F.lit(0.5)) / F.lit(float(1 << HASH_BITS))


def keyed_normal(seed: int, *keys: Column) -> Column:
    """Standard normal number from two keyed uniforms (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(keyed_uniform(seed, *keys, F.lit("r"))))
    return radius * F.cos(F.lit(2 * 3.141592653589793) * keyed_uniform(seed, *keys, F.lit("a")))
