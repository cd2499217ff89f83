"""Structured Streaming forms of the live plans."""
