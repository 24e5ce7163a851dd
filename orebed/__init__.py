"""Drillhole, block-model and ensemble analytics on Spark DataFrames."""
