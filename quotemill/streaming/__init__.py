"""The operators over unbounded ticks."""
