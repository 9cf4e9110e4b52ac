"""Incremental runs of the operators with Structured Streaming."""
