"""Streaming forms of the measures."""
