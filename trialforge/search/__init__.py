"""Search over small rules: enumeration, gates, nested selection, locks, controls, and what to try next."""
