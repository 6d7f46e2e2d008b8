"""Training-data operators: deduplication, filters, extraction, scoring, mixing, encoding and search over Spark tables."""
