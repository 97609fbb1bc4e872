"""Raster change analytics on Spark DataFrames."""
