"""Column functions: they take and give columns and hold no state."""
