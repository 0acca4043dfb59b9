"""Result files for inspection."""

from pyspark.sql import DataFrame


def write_csv(frame: DataFrame, path: str) -> None:
    """One folder of CSV files with headers; an empty result has headers only."""
    frame.write.mode("overwrite").option("header", True).csv(path)
