"""Event ingest as Structured Streaming."""
