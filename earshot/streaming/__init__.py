"""Structured Streaming: levels of event streams, compressor state across chunks."""
