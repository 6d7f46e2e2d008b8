"""The exact roster optimiser and what is served from it."""
