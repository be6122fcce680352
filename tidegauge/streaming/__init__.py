"""Structured Streaming forms of the rolling operators."""
