"""Experiments built from several operators, and the registered queries with their SQL."""
