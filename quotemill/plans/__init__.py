"""Whole queries: operators put together over the given tables."""
