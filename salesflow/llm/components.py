"""Connected components of a table of links, in Spark."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow.llm.common import Stored


def components(links: DataFrame, stored: Stored) -> DataFrame:
    """node, root: every node of ``links`` (a, b) and the smallest node of its component.

    Alternates two steps until nothing changes: each node ties its larger neighbours, then
    its smaller ones, to the smallest it knows. Rounds grow as the logarithm of the longest
    path. Every round is a written table, so lineage stays short and lost executors cost one
    round at most. Sums and counts of a few numbers are all that the driver sees.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        larger = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        smallest = larger.groupBy("a").agg(F.min("b").alias("m"))
        known = larger.join(smallest, "a")
        tied = known.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(tied.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        before = now
