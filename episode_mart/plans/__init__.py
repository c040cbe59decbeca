"""Ordered compositions of the operators: clean, enrich, publish, refresh."""
