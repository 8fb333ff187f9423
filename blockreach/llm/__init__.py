"""Operators for large-scale training text, their queries and SQL."""
