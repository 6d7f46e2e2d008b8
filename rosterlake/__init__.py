"""Spark-first analytics for weekly roster construction: sources, text cleanup, pools, exact optimisation, streaming."""
