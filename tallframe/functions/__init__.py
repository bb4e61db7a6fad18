"""Column functions: scales, labels, comparisons and rounding."""
