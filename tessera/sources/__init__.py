"""Inputs: files, rows in memory, and tables kept as versioned Parquet."""
