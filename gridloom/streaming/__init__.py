"""Structured Streaming forms of the ordered and stateful operators."""
