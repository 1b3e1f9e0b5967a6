"""Incremental runs of batch operators with Structured Streaming."""
