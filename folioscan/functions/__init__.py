"""Column expressions on text."""
