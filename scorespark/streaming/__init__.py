"""Structured Streaming twins of the timeline operators."""
