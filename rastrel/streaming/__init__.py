"""Streaming ingest of uploads."""
