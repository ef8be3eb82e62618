"""Structured Streaming forms of ingest (ST1) and error counting (ST2).

These are Spark-side additions: the reference has no streaming."""
from logcase.streaming.stream import error_counts_stream, ingest_stream, read_events_stream

__all__ = ["ingest_stream", "read_events_stream", "error_counts_stream"]
