"""Synthetic transactions of any size, made where they are stored.

Every value is a function of the row id and a seed. There is no sequential random
generator, so tasks do not depend on each other.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesflow.functions import LANE_BITS, digest, lane, uniform
from salesflow.sources.lookups import Lookups

# --- fixed values: the shape of the data ------------------------------------
ZIP_NOISE = {
    "zip4": 0.20,
    "leading_trailing_spaces": 0.15,
    "embedded_space": 0.10,
    "alpha_prefix": 0.07,
    "lowercase": 0.06,
    "intl": 0.05,
    "invalid": 0.04,
    "null": 0.03,
}
PARETO_ALPHA = 1.16
ZIP_WEIGHT_MARKER = 0.5
ZIP_WEIGHT_LOCAL = 3.0
ZIP_WEIGHT_OTHER = 1.0
SAME_DAY_SHARE = 0.05
EARLY_SHARE = 0.03
LONG_TAIL_SHARE = 0.04
MISSING_SHARE = 0.04
START_DATE = "2025-10-01"
# --- end of fixed values ----------------------------------------------------

BLOCK_DIGITS = 2
"""Hex digits that name a block of the two-level running sum: 256 blocks."""

LINE_BITS = 62
"""The line of weights is so many bits long: two lanes of a digest name a point. A key with the
smallest weight still has a piece of it while all weights together are under 2**52 units."""

MIN_SLICE_BITS, MAX_SLICE_BITS = 8, 28

BROADCAST_BITS = 16
"""Pieces number at most keys + 2**bits; up to these bits they are sent with a small lookup."""

WEIGHT_SCALE = 1_000_000
"""Weights are whole numbers in this unit, so running sums are exact."""


def sku_weights(skus: DataFrame, alpha: float = PARETO_ALPHA, seed: str = "sku") -> DataFrame:
    """``sku_id`` with a long-tail ``weight``, by inverting the Pareto distribution."""
    u = uniform(digest(F.col("sku_id"), seed), 0)
    pareto = F.pow(1 - u, F.lit(-1.0 / alpha)) - 1
    return skus.select("sku_id", F.ceil(pareto * WEIGHT_SCALE).cast("long").alias("weight"))


def zip_weights(zips: DataFrame) -> DataFrame:
    """``zip_code`` with a ``weight``: the home state counts most, the marker least."""
    weight = (
        F.when(F.col("zip_code") == "00000", ZIP_WEIGHT_MARKER)
        .when(F.col("state") == "CA", ZIP_WEIGHT_LOCAL)
        .otherwise(ZIP_WEIGHT_OTHER)
    )
    return zips.select("zip_code", (weight * WEIGHT_SCALE).cast("long").alias("weight"))


def weight_intervals(weighted: DataFrame, key: str) -> DataFrame:
    """Adjoining pieces ``[lo, hi)`` of the line ``[0, 2**LINE_BITS)``, one per key, as
    wide as the key's share of all weight.

    The running sum has two levels: within blocks, and over one row per block.
    The number of blocks is fixed, so no task ever orders the whole lookup.
    """
    block = F.substring(F.md5(F.col(key)), 1, BLOCK_DIGITS)
    placed = weighted.withColumn("_block", block)
    sums = placed.groupBy("_block").agg(F.sum("weight").alias("_sum"))
    everything = W.partitionBy(F.lit(1))
    so_far = everything.orderBy("_block").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = sums.select(
        "_block",
        (F.sum("_sum").over(so_far) - F.col("_sum")).alias("_start"),
        F.sum("_sum").over(everything).alias("_end"),
    )
    within = W.partitionBy("_block").orderBy(key).rowsBetween(W.unboundedPreceding, W.currentRow)
    reached = placed.withColumn("_reached", F.sum("weight").over(within))
    upper = F.col("_start") + F.col("_reached")
    # starts holds one row per block: at most 256
    return reached.join(F.broadcast(starts), "_block").select(
        key, _cut(upper - F.col("weight")).alias("lo"), _cut(upper).alias("hi")
    )


def slice_bits(keys: int) -> int:
    """Bits for about one slice of the line per key."""
    return max(MIN_SLICE_BITS, min(MAX_SLICE_BITS, keys.bit_length()))


def sample_weighted(rows: DataFrame, point: Column, intervals: DataFrame, key: str, bits: int, small: bool) -> DataFrame:
    """Give each row a key with probability proportional to its weight.

    ``point`` is a whole number on the line. Intervals are cut into 2**bits equal
    slices and joined on the slice, then filtered. Points fall evenly on slices,
    so no slice is hot however skewed the weights are, and a row meets about
    1 + keys / 2**bits pieces, of which exactly one holds it.
    """
    shift = LINE_BITS - bits
    slices = F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))
    pieces = intervals.filter("hi > lo").select(key, "lo", "hi", F.explode(slices).alias("_slice"))
    aimed = rows.withColumn("_point", point).withColumn("_slice", F.shiftright("_point", shift))
    joined = aimed.join(F.broadcast(pieces) if small and bits <= BROADCAST_BITS else pieces, "_slice")
    held = (F.col("_point") >= F.col("lo")) & (F.col("_point") < F.col("hi"))
    return joined.filter(held).drop("_slice", "_point", "lo", "hi")


def _cut(weight: Column) -> Column:
    """A running weight's place on the line. Monotone, and the full weight lands
    exactly on the end: scaling by a power of two does not round."""
    return F.floor(weight.cast("double") * F.lit(2.0**LINE_BITS) / F.col("_end").cast("double"))


def point(digested: Column, index: int) -> Column:
    """A whole number on the line, from two neighbouring lanes."""
    return lane(digested, index) * F.lit(1 << (LINE_BITS - LANE_BITS)) + F.shiftright(lane(digested, index + 1), 2 * LANE_BITS - LINE_BITS)


def noisy_zip(code: Column, shape: Column, extra: Column) -> Column:
    """One of the dirty forms of a ZIP code; ``shape`` and ``extra`` are uniform."""
    four = F.lpad(F.floor(extra * 10000).cast("string"), 4, "0")
    forms = {
        "zip4": F.concat(code, F.lit("-"), four),
        "leading_trailing_spaces": F.concat(F.lit(" "), code, F.lit("  ")),
        "embedded_space": F.concat(F.substring(code, 1, 3), F.lit(" "), F.substring(code, 4, 20)),
        "alpha_prefix": F.concat(F.lit("ZIP"), code),
        "lowercase": F.lower(code),
        "intl": F.lit("INTL 00000"),
        "invalid": F.lit("INVALID_ZIP"),
        "null": F.lit(None).cast("string"),
    }
    chosen, bound = None, 0.0
    for name, share in ZIP_NOISE.items():
        bound = round(bound + share, 10)
        hit = shape < F.lit(bound)
        chosen = F.when(hit, forms[name]) if chosen is None else chosen.when(hit, forms[name])
    return chosen.otherwise(code)


def maturity_text(day: Column, row: Column, seed: str = "txn") -> Column:
    """Maturity as text. A later rule wins over an earlier one: usual offset, same
    day, early, long tail, missing."""
    kinds, offsets = digest(row, f"{seed}-kinds"), digest(row, f"{seed}-offsets")
    same_day, early = uniform(kinds, 0), uniform(kinds, 1)
    long_tail, missing = uniform(kinds, 2), uniform(kinds, 3)
    offset = (
        F.when(long_tail < LONG_TAIL_SHARE, 45 + F.floor(uniform(offsets, 2) * 75))
        .when(early < EARLY_SHARE, -1 - F.floor(uniform(offsets, 1) * 4))
        .when(same_day < SAME_DAY_SHARE, F.lit(0).cast("long"))
        .otherwise(1 + F.floor(uniform(offsets, 0) * 44))
    )
    return F.when(missing >= MISSING_SHARE, F.date_add(day, offset.cast("int")).cast("string"))


def growth_day(row_id: Column, first_day_rows: Column | int, rows_per_day: int) -> Column:
    """Day number of a row id: a large first day, then equal later days."""
    later = F.floor((row_id - F.lit(first_day_rows)) / F.lit(rows_per_day))
    return F.when(row_id < F.lit(first_day_rows), F.lit(1).cast("long")).otherwise(later + 2)


def transactions(
    ids: DataFrame,
    lookups: Lookups,
    first_day_rows: int,
    rows_per_day: int,
    bits: int,
    seed: str = "txn",
) -> DataFrame:
    """The seven source columns for a frame of row numbers ``id``."""
    row = F.col("id")
    number = growth_day(row, first_day_rows, rows_per_day)
    based = ids.select(
        "id",
        F.date_add(F.lit(START_DATE).cast("date"), (number - 1).cast("int")).alias("_day"),
        digest(row, f"{seed}-picks").alias("_picks"),
    )
    intervals = weight_intervals(sku_weights(lookups.sku), "sku_id")
    place = point(digest(row, f"{seed}-places"), 0)
    with_sku = sample_weighted(based, place, intervals, "sku_id", bits, lookups.sku_small)
    return with_sku.transform(with_noisy_zip, lookups, bits, seed).select(
        F.concat(F.lit("TXN_"), _padded(row, 10)).alias("transaction_id"),
        F.col("_day").cast("string").alias("transaction_date"),
        "sku_id",
        (1 + F.floor(uniform(F.col("_picks"), 1) * 10)).alias("quantity_sold"),
        ((500 + F.floor(uniform(F.col("_picks"), 2) * 49501)) / F.lit(100.0)).alias("revenue_usd"),
        maturity_text(F.col("_day"), row, seed).alias("maturity_date"),
        "zip_code_raw",
    )


def with_noisy_zip(ids: DataFrame, lookups: Lookups, bits: int, seed: str = "txn") -> DataFrame:
    """Add a weighted ``zip_code`` and its dirty form ``zip_code_raw``."""
    row = F.col("id")
    intervals = weight_intervals(zip_weights(lookups.zip), "zip_code")
    place = point(digest(row, f"{seed}-places"), 2)
    picked = sample_weighted(ids, place, intervals, "zip_code", bits, lookups.zip_whole_small)
    noise = digest(row, f"{seed}-noise")
    return picked.withColumn("zip_code_raw", noisy_zip(F.col("zip_code"), uniform(noise, 0), uniform(noise, 1)))


def filter_rows(ids: DataFrame, days: int = 10, skus: int = 4999, seed: str = "flat") -> DataFrame:
    """The flat four-column table of the date-filter measurement."""
    pick = digest(F.col("id"), seed)
    day = F.date_add(F.lit(START_DATE).cast("date"), F.floor(uniform(pick, 0) * days).cast("int"))
    return ids.select(
        F.col("id").alias("transaction_id"),
        day.cast("string").alias("transaction_date"),
        F.concat(F.lit("SKU_"), (1 + F.floor(uniform(pick, 1) * skus)).cast("string")).alias("sku_id"),
        (1 + F.floor(uniform(pick, 2) * 9)).alias("quantity"),
    )


def _padded(number: Column, width: int) -> Column:
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))
