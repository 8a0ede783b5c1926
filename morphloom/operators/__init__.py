"""operators of the subword engine."""
