"""Incremental scoring of streams."""
