"""Readers of metadata, features and rasters, all through Spark's own file readers."""
