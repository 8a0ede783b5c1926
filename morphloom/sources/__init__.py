"""sources of the subword engine."""
