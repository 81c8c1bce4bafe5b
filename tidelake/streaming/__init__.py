"""Structured Streaming entry points; each runs the batch operators per micro-batch."""
