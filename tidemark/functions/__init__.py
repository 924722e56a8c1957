"""Column expressions and small helpers for web logs."""
