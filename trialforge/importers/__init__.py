"""Importers: exported recordings into the normalised tables."""
