"""Repeatable random numbers derived from a row id.

The value depends only on (id, seed): not on partitioning, task retries or the
cluster size, so a lost executor recomputes exactly the rows it held.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

LANES = 4
LANE_BITS = 32
STEPS = 2.0**LANE_BITS


def digest(row_id: Column, seed: str) -> Column:
    """128 pseudo-random bits as hex text; ``uniform`` cuts four numbers from it."""
    return F.md5(F.concat(row_id.cast("string"), F.lit(f":{seed}")))


def lane(hex_digest: Column, index: int) -> Column:
    """A whole number in [0, 2**32): one of the digest's four 32-bit lanes."""
    if not 0 <= index < LANES:
        raise ValueError(f"index must be in 0..{LANES - 1}")
    return F.conv(F.substring(hex_digest, 1 + 8 * index, 8), 16, 10).cast("long")


def uniform(hex_digest: Column, index: int) -> Column:
    """A double in [0, 1) from one lane."""
    return lane(hex_digest, index).cast("double") / F.lit(STEPS)
