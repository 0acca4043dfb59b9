"""Readers: typed CSV and Parquet, lookups, zipped archives, the landing table."""
