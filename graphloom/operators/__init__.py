"""Operators of the code-graph engine."""
