"""Column and SQL building blocks."""
