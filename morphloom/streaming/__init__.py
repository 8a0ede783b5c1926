"""streaming of the subword engine."""
