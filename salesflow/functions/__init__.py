"""Column expressions. All are built-in Spark functions, so they stay in codegen."""

from salesflow.functions.dates import lenient_date, strict_date
from salesflow.functions.money import per, to_units, to_usd
from salesflow.functions.uniform import LANE_BITS, digest, lane, uniform
from salesflow.functions.zips import complete_code, zip_candidate

__all__ = [
    "LANE_BITS",
    "complete_code",
    "digest",
    "lane",
    "lenient_date",
    "per",
    "strict_date",
    "to_units",
    "to_usd",
    "uniform",
    "zip_candidate",
]
