"""Streaming of the vector-identity engine."""
