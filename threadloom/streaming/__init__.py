"""Structured Streaming jobs over the same tables as the batch operators."""
