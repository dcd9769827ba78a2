"""Incremental (Structured Streaming) counterparts of the batch steps."""
