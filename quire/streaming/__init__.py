"""Structured Streaming jobs: partial-record fold (SM1) and continuous ingest (SM2)."""
