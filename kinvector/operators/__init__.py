"""Operators of the vector-identity engine."""
