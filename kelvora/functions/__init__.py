"""Column expressions and scalar models."""
