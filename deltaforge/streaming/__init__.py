"""Structured Streaming forms of applying and computing differences."""
