"""Column expressions: text rules and vector arithmetic."""
