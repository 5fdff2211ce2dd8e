"""Column expressions and grouped building blocks."""
