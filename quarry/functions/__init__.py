"""Column functions: every function takes and returns Columns."""
