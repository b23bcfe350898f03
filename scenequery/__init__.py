"""Raster, catalogue and corpus analytics as Spark DataFrames."""
