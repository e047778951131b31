"""Plans of the vector-identity engine."""
