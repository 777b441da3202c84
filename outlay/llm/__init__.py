"""Operators that a large training-data pipeline needs, one module each."""
