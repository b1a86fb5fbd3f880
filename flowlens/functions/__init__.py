"""Column expressions and order helpers."""
