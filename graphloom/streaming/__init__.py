"""Structured Streaming forms of the edge operators."""
