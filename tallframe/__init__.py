"""Time-aligned signal features as tall Spark tables."""
