"""Execution of compiled rules: over numpy arrays for whole runs, over columns for one tick."""
