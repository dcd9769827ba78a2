"""Readers, writers and the catalog of Parquet tables."""
