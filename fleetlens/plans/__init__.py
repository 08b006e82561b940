"""Whole questions put together from operators, and the bindings of the driver tables."""
