"""Column expressions over signals, audiograms, keys and text."""
