"""Geospatial annotation analytics on Spark."""
