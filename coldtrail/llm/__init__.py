"""Operators for training-data pipelines: dedup, filtering, scoring, formatting, packing, mixing."""
