"""Raster analytics expressed as Spark relations."""
