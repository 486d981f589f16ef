"""Streaming forms: request limits, incremental ingest, idle expiry, job state."""
