"""Column expressions and numeric functions."""
