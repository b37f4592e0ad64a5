"""Column builders and small pure functions."""
