"""Streaming of the code-graph engine."""
