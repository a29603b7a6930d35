"""Column builders: everything that maps a value to a value."""
