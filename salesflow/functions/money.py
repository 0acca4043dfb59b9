"""Money is summed as whole ten-thousandths of a dollar.

A sum of doubles depends on the order in which partitions arrive, which would
change rank ties between two runs of one job. A sum of longs does not, needs no
wide decimal buffer, and under ANSI fails on overflow instead of wrapping. Nothing
is cut: an amount finer than that unit fails the run.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = 10_000
"""Units of a dollar; the documented scale of revenue."""

TOLERANCE = 4 * 2.0**-52
"""What the nearest double of an exact amount may be off, as a share of it: a few last bits."""


def to_units(usd: Column) -> Column:
    scaled = usd * UNITS
    whole = F.rint(scaled)
    finer = F.raise_error(F.lit(f"revenue finer than 1/{UNITS} of a dollar")).cast("long")
    return F.when(F.abs(scaled - whole) > F.abs(scaled) * TOLERANCE, finer).otherwise(whole.cast("long"))


def to_usd(units: Column) -> Column:
    return units.cast("double") / F.lit(float(UNITS))


def per(total: Column, count: Column) -> Column:
    """``total / count`` as a double, null where nothing was counted."""
    return F.when(count > 0, total.cast("double") / count.cast("double"))
