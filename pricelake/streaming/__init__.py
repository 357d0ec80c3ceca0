"""Structured Streaming forms of the ingestion reports."""
