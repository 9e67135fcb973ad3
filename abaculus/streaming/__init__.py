"""Structured Streaming: directory ingestion and windowed checks."""
