"""Incremental runs started by arriving files."""
