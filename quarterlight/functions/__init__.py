"""Column functions: periods and texts."""
