"""Relational operators: statistics, work lists, framing, splits. Each takes and returns DataFrames."""
