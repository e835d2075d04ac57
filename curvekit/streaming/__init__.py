"""Incremental versions of the curve jobs on Structured Streaming."""
