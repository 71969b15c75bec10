"""Column expressions, schema helpers and distribution functions."""
