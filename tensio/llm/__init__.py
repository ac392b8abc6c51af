"""Operators of a large-scale training-data pipeline over the ``documents``-like tables."""
