"""The full pipeline, and its result record."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow.operators.aggregate import counted_sums, sales_aggregate, split_counted
from salesflow.operators.clean import clean
from salesflow.operators.topk import max_date, top_latest_day
from salesflow.operators.windows import share_and_rank
from salesflow.schemas import IMPUTE_DAYS, SALES_COLUMNS
from salesflow.session import Scratch
from salesflow.sources.lookups import Lookups


def sales(
    txn: DataFrame,
    lookups: Lookups,
    by: Sequence[str] = (),
    impute_days: int = IMPUTE_DAYS,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Raw transactions to the fourteen-column aggregate (after any ``by`` keys)."""
    aggregated = txn.transform(clean, impute_days).transform(sales_aggregate, lookups, by)
    return _ranked(aggregated, lookups, by, scratch)


def _ranked(aggregated, lookups, by, scratch):
    ranked = aggregated.transform(share_and_rank, by, wide=not lookups.few_groups, scratch=scratch)
    return ranked.select(*by, *SALES_COLUMNS)


@dataclass(frozen=True)
class Artifacts:
    """The frames one run offers. They read what the run stored, not the transactions."""

    aggregated: DataFrame
    top_slice: DataFrame
    quality: DataFrame
    target_date: DataFrame
    scratch: Scratch


def run(
    txn: DataFrame,
    lookups: Lookups,
    by: Sequence[str] = (),
    impute_days: int = IMPUTE_DAYS,
    scratch: Scratch | None = None,
) -> Artifacts:
    """One pass over the transactions, for the result and for the quality counters.

    Its sums are stored, and everything else starts from them. ``Artifacts.scratch`` is the
    caller's to drop when the frames are no longer needed.
    """
    scratch = scratch or Scratch(txn.sparkSession)
    sums = scratch(counted_sums(clean(txn, impute_days), lookups, by), "sums")
    aggregated, quality = split_counted(sums)
    aggregated = _ranked(aggregated, lookups, by, scratch)
    return Artifacts(
        aggregated=aggregated,
        top_slice=top_latest_day(aggregated),
        quality=quality,
        target_date=max_date(aggregated),
        scratch=scratch,
    )


def text_dates(frame: DataFrame) -> DataFrame:
    """Date columns as ``yyyy-MM-dd`` text."""
    dates = {c: F.col(c).cast("string") for c, kind in frame.dtypes if kind == "date"}
    return frame.withColumns(dates) if dates else frame
