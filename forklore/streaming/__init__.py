"""Incremental ingest of exports and per-thread state, with Structured Streaming."""
