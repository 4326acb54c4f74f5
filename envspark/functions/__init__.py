"""Column expressions: no reads, no actions."""
