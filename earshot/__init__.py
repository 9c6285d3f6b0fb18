"""Hearing-analytics on Spark: signals, audiograms, scenes and scores as DataFrames."""
