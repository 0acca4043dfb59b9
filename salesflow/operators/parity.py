"""Compare an incremental result with a recomputed one."""

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesflow.operators.clean import on_date
from salesflow.schemas import DIFF_ATOL, GROUP_KEYS, METRICS, PARITY_ATOL, PARITY_RTOL

EXACT = ["total_quantity", "order_count", "revenue_rank"]
LEFT, RIGHT = "incremental", "baseline"


def parity_join(
    incremental: DataFrame,
    baseline: DataFrame,
    day: str | None = None,
    keys: list[str] = GROUP_KEYS,
    atol: float = PARITY_ATOL,
    rtol: float = PARITY_RTOL,
) -> DataFrame:
    """Full outer join on the group keys, with ``differs_<metric>`` per metric.

    Keys are unique on each side, so no key is hot. Null keys match each other.
    A metric differs when one side is null and the other is not, or when the
    values are further apart than ``atol + rtol * |baseline|``; counts and ranks must be equal.
    """
    left, right = _side(incremental, LEFT, day, keys), _side(baseline, RIGHT, day, keys)
    same_key = [F.col(f"_{LEFT}_{k}").eqNullSafe(F.col(f"_{RIGHT}_{k}")) for k in keys]
    in_left, in_right = F.col(f"_in_{LEFT}").isNotNull(), F.col(f"_in_{RIGHT}").isNotNull()
    joined = left.join(right, same_key, "full").select(
        *[F.coalesce(f"_{LEFT}_{k}", f"_{RIGHT}_{k}").alias(k) for k in keys],
        F.when(in_left & in_right, "both").when(in_left, LEFT).otherwise(RIGHT).alias("found_in"),
        *[f"{m}_{side}" for m in METRICS for side in (LEFT, RIGHT)],
    )
    return joined.withColumns({f"differs_{m}": _differs(m, atol, rtol) for m in METRICS})


def parity_diff(incremental: DataFrame, baseline: DataFrame, day: str | None = None, **kw) -> DataFrame:
    """The keys that differ, with both sides' metrics. Looks at absolute distance, so
    it also names small differences in large values, which the verdict lets pass."""
    checks = [F.col(f"differs_{m}") for m in METRICS] + [F.col("found_in") != "both"]
    flags = [f"differs_{m}" for m in METRICS]
    joined = parity_join(incremental, baseline, day, atol=DIFF_ATOL, rtol=0.0, **kw)
    return joined.filter(reduce(or_, checks)).drop(*flags)


def parity_head(diff: DataFrame, k: int = 5, keys: list[str] = GROUP_KEYS) -> DataFrame:
    """The first rows of a difference, for a message."""
    return diff.orderBy(*keys).limit(k)


def parity_summary(
    incremental: DataFrame, baseline: DataFrame, day: str | None = None, by: Sequence[str] = (), **kw
) -> DataFrame:
    """One row (or one per ``by``): how many keys were compared, are missing, or differ per metric.

    Nothing to compare is a pass. So is an incremental side without any row, as
    there was then nothing to process.
    """
    one_sided = F.col("found_in") != "both"
    counts = parity_join(incremental, baseline, day, **kw).groupBy(*by).agg(
        F.count(F.lit(1)).alias("keys_compared"),
        F.count_if(F.col("found_in") != RIGHT).alias("incremental_keys"),
        F.count_if(F.col("found_in") == LEFT).alias("only_in_incremental"),
        F.count_if(F.col("found_in") == RIGHT).alias("only_in_baseline"),
        *[F.count_if(~one_sided & F.col(f"differs_{m}")).alias(f"differs_{m}") for m in METRICS],
    )
    problems = [F.col(c) for c in counts.columns if c.startswith(("only_in", "differs_"))]
    clean = reduce(lambda a, b: a + b, problems) == 0
    passed = clean | (F.col("incremental_keys") == 0)
    return counts.withColumn("parity_pass", passed)


def _side(frame: DataFrame, side: str, day: str | None, keys: list[str]) -> DataFrame:
    rows = frame if day is None else frame.transform(on_date, day)
    return rows.select(
        *[F.col(k).alias(f"_{side}_{k}") for k in keys],
        *[F.col(m).alias(f"{m}_{side}") for m in METRICS],
        F.lit(True).alias(f"_in_{side}"),
    )


def _differs(metric: str, atol: float, rtol: float) -> Column:
    a, b = F.col(f"{metric}_{LEFT}"), F.col(f"{metric}_{RIGHT}")
    if metric in EXACT:
        return ~a.eqNullSafe(b)
    apart = F.abs(a - b) > F.lit(atol) + F.lit(rtol) * F.abs(b)
    return (a.isNull() != b.isNull()) | F.coalesce(apart, F.lit(False))
