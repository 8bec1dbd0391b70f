"""Structured Streaming twins of the state operators."""
