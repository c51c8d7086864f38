"""Column-level helpers and fixed name tables."""
