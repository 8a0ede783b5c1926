"""plans of the subword engine."""
