"""Plan helpers: shared folders, dense codes, skew handling."""
