"""Numeric models on numpy, run inside grouped tasks or on small tables."""
