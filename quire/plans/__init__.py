"""Derived tables and the query catalogue (what the driver and bench run)."""
