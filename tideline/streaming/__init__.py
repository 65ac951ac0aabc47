"""Structured Streaming jobs over price ticks."""
