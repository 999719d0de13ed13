"""Structured Streaming versions of the incremental feeds."""
