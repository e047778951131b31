"""Sources of the vector-identity engine."""
