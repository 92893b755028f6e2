"""Column → Column building blocks; no Python code runs per row."""
