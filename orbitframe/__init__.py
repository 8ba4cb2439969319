"""Imagery-geometry analytics as Spark DataFrame operators."""
