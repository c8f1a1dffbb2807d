"""Column and literal helpers."""
