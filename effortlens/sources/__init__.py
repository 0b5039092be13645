"""Readers and writers: CSV, JSON, Parquet stores, models."""
