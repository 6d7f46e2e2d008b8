"""Incremental snapshot refresh."""
