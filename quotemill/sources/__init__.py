"""Feeds, lookup tables and sinks."""
