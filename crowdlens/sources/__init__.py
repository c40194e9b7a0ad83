"""Readers and writers: raw JSON, Parquet tables, events."""
