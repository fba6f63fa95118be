"""Structured Streaming: incremental ingest and the stateful rate limiter."""
