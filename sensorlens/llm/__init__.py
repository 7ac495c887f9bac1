"""Operators for large training-data pipelines: text tables in, text tables out."""
