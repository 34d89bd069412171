"""Operators of a training-data pipeline: scoring, cleaning, matching and packing of whole text corpora."""
