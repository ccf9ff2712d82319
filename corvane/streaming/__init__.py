"""Structured Streaming variants of the history and request operators. They are this library's own."""
