"""Structured Streaming ingest (an extension; the registry itself is batch)."""
