"""Column expressions and plain-Python parsing and validation."""
