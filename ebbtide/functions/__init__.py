"""Column expressions, also registered as SQL functions."""
