"""Functions of the vector-identity engine."""
