"""Structured Streaming jobs over the decision and flag feeds."""
