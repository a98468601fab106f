"""Incremental scoring of observations as they arrive."""
