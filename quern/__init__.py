"""Leakage-safe tabular analytics as Spark plans."""
