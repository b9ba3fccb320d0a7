"""Column -> column helpers."""
