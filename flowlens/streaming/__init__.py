"""Structured Streaming forms of the windowed and stateful operators."""
