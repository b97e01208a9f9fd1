"""Ingestion by Structured Streaming."""

from .ingest import StreamWriter, ingest_stream, rate_samples

__all__ = ["StreamWriter", "ingest_stream", "rate_samples"]
