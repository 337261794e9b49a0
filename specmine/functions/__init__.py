"""Column functions from built-in expressions."""
