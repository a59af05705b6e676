"""Column expressions: property rules and similarity metrics."""
