"""Readers for documents, markers, logs and snapshots, and report writers."""
