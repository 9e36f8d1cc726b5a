"""Structured Streaming: ingest, running trends, matching of new revisions."""
