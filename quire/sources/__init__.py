"""Scans: driver tables, page files, JSON record files."""
