"""Raster, displacement and corpus analytics on PySpark."""
