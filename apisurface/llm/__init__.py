"""Operators of a training-data pipeline: search, dedup, formatting, packing, filters, tokens and language."""
