"""Structured Streaming forms of the follow, wait and change queries."""
