"""Composite analyses and the query registry."""
