"""functions of the subword engine."""
