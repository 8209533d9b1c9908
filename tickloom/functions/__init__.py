"""Column-level indicator definitions."""
