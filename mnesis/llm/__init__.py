"""Operators for training-data pipelines on text, names and vectors. Nothing outside imports this package."""
