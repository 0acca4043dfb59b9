"""Daily sales snapshots on Spark: clean, enrich, aggregate, rank, and keep the
result in a partitioned table that is updated incrementally per client."""
