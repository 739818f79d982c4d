"""Incremental ingest with Structured Streaming (ST1-ST7)."""
