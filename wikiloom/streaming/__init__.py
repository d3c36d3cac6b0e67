"""Incremental ingestion and metrics with Structured Streaming."""
