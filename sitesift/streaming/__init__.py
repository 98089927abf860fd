"""Structured Streaming forms of the incremental pipeline."""
