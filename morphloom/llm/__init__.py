"""Operators of a training-data pipeline: search, filters, packing, scoring, storage."""
