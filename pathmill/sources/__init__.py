"""Readers and writers: Parquet, CSV, JDBC, generated rows, and views in shared storage."""
