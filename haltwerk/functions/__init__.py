"""Column expressions and reusable frame-level building blocks."""
