"""Structured Streaming: ingest, running counters, live view, progress."""
