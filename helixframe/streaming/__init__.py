"""Streaming forms of the operators: not built yet."""
