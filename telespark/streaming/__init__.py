"""Incremental (Structured Streaming) ingest of arriving log files."""
