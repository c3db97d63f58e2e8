"""Structured Streaming forms of the word and heartbeat operators."""
