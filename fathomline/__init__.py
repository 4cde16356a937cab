"""Chunk-level deduplication analytics and corpus preparation on PySpark."""
