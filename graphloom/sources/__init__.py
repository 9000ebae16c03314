"""Sources of the code-graph engine."""
