"""Per-level Parquet tables."""
