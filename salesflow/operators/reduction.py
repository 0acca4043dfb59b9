"""Keys of a lookup as bitmaps, so that rows without a match are not shuffled to its join.

A Bloom filter of one hash: a key sets one of 2**bits bits, kept as rows of 4 KB bitmaps. Their total is
bounded by ``MOST_BITS``, whatever the lookup's size, so they are broadcast. A row whose bit
is not set has no match for certain. A set bit may be another key's; the join decides.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
"""About one in so many rows without a match is still shuffled, while the filter is not full."""

BITMAP_BITS = 15
"""Of one bitmap of the built-in functions: 4 KB."""

MOST_BITS = 28
"""Bitmaps of at most 32 MB together."""


def filter_bits(keys: int) -> int:
    return max(BITMAP_BITS, min(MOST_BITS, (keys * BITS_PER_KEY).bit_length()))


def key_bitmaps(lookup: DataFrame, key: str, bits: int) -> DataFrame:
    """``_bucket``, ``_bitmap``: at most 2**(bits - BITMAP_BITS) rows."""
    bucket, position = _place(F.col(key), bits)
    placed = lookup.filter(F.col(key).isNotNull()).select(bucket.alias("_bucket"), position.alias("_position"))
    return placed.groupBy("_bucket").agg(F.bitmap_construct_agg("_position").alias("_bitmap"))


def with_match(frame: DataFrame, bitmaps: DataFrame, key: str, bits: int) -> DataFrame:
    """Adds ``_may_match``; false for null keys."""
    bucket, position = _place(F.col(key), bits)
    byte = F.conv(F.hex(F.substring(F.col("_bitmap"), F.shiftright(position, 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, position.bitwiseAND(7)) == 1
    marked = frame.withColumn("_bucket", bucket).join(F.broadcast(bitmaps), "_bucket", "left")
    return marked.withColumn("_may_match", F.coalesce(is_set, F.lit(False)) & F.col(key).isNotNull()).drop("_bucket", "_bitmap")


def reduced_join(frame: DataFrame, lookup: DataFrame, key: str, keys: int, join: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``join(frame, lookup)`` on ``key``, a left join, for a lookup of about ``keys`` rows that is
    too large to broadcast. Only rows that may match are shuffled; the others are joined with nothing."""
    bits = filter_bits(keys)
    marked = with_match(frame, key_bitmaps(lookup, key, bits), key, bits)
    nothing = lookup.filter(F.lit(False))  # planned as a projection of nulls
    found = join(marked.filter("_may_match").drop("_may_match"), lookup)
    return found.unionByName(join(marked.filter("not _may_match").drop("_may_match"), nothing))


def _place(key: Column, bits: int) -> tuple[Column, Column]:
    place = F.xxhash64(key).bitwiseAND((1 << bits) - 1)
    return F.shiftright(place, BITMAP_BITS), place.bitwiseAND((1 << BITMAP_BITS) - 1).cast("int")
