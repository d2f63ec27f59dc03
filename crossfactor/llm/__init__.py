"""Operators of a training-data pipeline: text scoring, extraction, near-duplicates, mixing, sharding, token counts."""
