"""Readers, source-side checks and writers."""
