"""The two lookups together with what is known about their size.

A lookup is broadcast only after one small job has measured it. Past the limit,
or when nothing was measured, the plans join by shuffle instead and keep narrow the
rows they move (see ``operators.aggregate``). Of the ZIP lookup only keys that a cleaned code
can equal are measured and joined: there are at most 100,000 of them, whatever its size.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow.functions import complete_code

BROADCAST_LIMIT = 64 * 1024 * 1024
"""Largest lookup, in estimated in-memory bytes, that is sent to every executor."""

HASH_LIMIT = 2 * 1024 * 1024 * 1024
"""Largest lookup whose shuffled parts are hashed by the tasks that join them. Past it, or when nothing was
measured, rows and lookup are sorted instead, which takes longer and spills."""

GROUP_LIMIT = 10_000
"""Most SKU groups (or categories) that one task is given to put in order."""

ROW_OVERHEAD = 64


@dataclass(frozen=True)
class Lookups:
    sku: DataFrame
    zip: DataFrame
    sku_small: bool = False
    zip_small: bool = False
    few_groups: bool = False
    few_categories: bool = False
    zip_whole_small: bool = False
    """With the keys that no cleaned code equals."""
    sku_hashed: bool = False
    """Past the broadcast limit, within the one for hashing."""

    @classmethod
    def measured(
        cls,
        sku: DataFrame,
        zips: DataFrame,
        broadcast_limit: int = BROADCAST_LIMIT,
        group_limit: int = GROUP_LIMIT,
        hash_limit: int = HASH_LIMIT,
    ) -> "Lookups":
        """Measure both lookups in one job that returns a few rows."""
        sizes = _widths(sku, F.lit("sku"), "sku_group", "category").unionByName(_widths(zips, F.when(complete_code("zip_code"), "zip").otherwise("zip_unusable")))
        found = {
            row["name"]: row
            for row in sizes.groupBy("name")
            .agg(
                F.sum("width").alias("size"),
                F.approx_count_distinct("group").alias("groups"),
                F.approx_count_distinct("category").alias("categories"),
            )
            .collect()
        }
        nothing = {"size": 0, "groups": 0, "categories": 0}
        sku_found, zip_found = found.get("sku", nothing), found.get("zip", nothing)
        return cls(
            sku=sku,
            zip=zips,
            sku_small=sku_found["size"] <= broadcast_limit,
            zip_small=zip_found["size"] <= broadcast_limit,
            few_groups=sku_found["groups"] <= group_limit,
            few_categories=sku_found["categories"] <= group_limit,
            zip_whole_small=zip_found["size"] + found.get("zip_unusable", nothing)["size"] <= broadcast_limit,
            sku_hashed=sku_found["size"] <= hash_limit,
        )

    def sku_side(self, frame: DataFrame | None = None) -> DataFrame:
        """The SKU lookup, or a frame no larger than it, hinted if it is small."""
        side = self.sku if frame is None else frame
        return side.hint("shuffle_hash") if self.sku_hashed and not self.sku_small else _hinted(side, self.sku_small)

    def zip_side(self, frame: DataFrame | None = None) -> DataFrame:
        """The rows of the ZIP lookup (or of a frame with its keys) that a cleaned code can match."""
        return _hinted((self.zip if frame is None else frame).filter(complete_code("zip_code")), self.zip_small)


def _widths(frame, name, group=None, category=None):
    text = [c for c, kind in frame.dtypes if kind == "string"]
    width = reduce(
        lambda a, b: a + b,
        [F.coalesce(F.octet_length(c), F.lit(0)) for c in text],
        F.lit(ROW_OVERHEAD),
    )
    absent = F.lit(None).cast("string")
    return frame.select(
        name.alias("name"),
        width.cast("long").alias("width"),
        (F.col(group) if group else absent).alias("group"),
        (F.col(category) if category else absent).alias("category"),
    )


def _hinted(frame, small):
    return F.broadcast(frame) if small else frame
