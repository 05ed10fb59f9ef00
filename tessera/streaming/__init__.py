"""Structured Streaming: keyed upserts by micro-batch."""
