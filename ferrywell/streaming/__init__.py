"""Structured Streaming wrappers around the batch loads."""
