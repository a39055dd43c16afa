"""Continuous ingestion of a log with Structured Streaming."""

from .ingest import ingest_into, latest_stream, log_stream

__all__ = ["ingest_into", "latest_stream", "log_stream"]
