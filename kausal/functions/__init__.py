"""Column expressions of the statistics."""
