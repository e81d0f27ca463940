"""Operators: each takes and returns DataFrames; Catalyst plans the work."""
