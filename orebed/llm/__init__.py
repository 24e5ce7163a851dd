"""Operators for training-data pipelines.  Nothing else in this package imports them."""
