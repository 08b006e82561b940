"""Column-in, Column-out helpers.  No Python runs per row."""
