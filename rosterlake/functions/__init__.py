"""Scalar expressions: names, numbers and dates."""
