"""Structured Streaming: the batch operators on micro-batches, with an idempotent sink."""
