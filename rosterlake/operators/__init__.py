"""Relational steps: statistics, candidate pool, request locks."""
