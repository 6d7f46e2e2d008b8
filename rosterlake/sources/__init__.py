"""Readers of snapshots and landed pages, and writers."""
