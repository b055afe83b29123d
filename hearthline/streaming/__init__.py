"""Streaming forms of queries over growing tables."""
