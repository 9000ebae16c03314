"""Functions of the code-graph engine."""
