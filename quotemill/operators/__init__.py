"""Operators over ticks and bars: every one takes and returns DataFrames."""
