"""Operators of a training-data pipeline: near duplicates, neighbours, packing, languages, quality, mixing, tokens."""
