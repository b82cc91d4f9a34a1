"""Exposure analytics on Spark: zones, cells and features as DataFrames."""
