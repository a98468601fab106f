"""Operators: relational building blocks, factor graphs, inference, learning, Boolean networks, drug analytics."""
