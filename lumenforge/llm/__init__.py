"""Operators for preparing training text: dedup, scans, scoring, mixing and sharding."""
