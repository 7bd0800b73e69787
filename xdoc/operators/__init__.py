"""Operators that compose several expressions: aggregates, containment, projection, path index."""
