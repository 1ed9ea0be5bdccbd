"""Structured Streaming versions of ingest and generation."""
