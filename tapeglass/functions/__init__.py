"""Column expressions: scores, labels, lifecycle, text keys."""
