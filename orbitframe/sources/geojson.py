"""GeoJSON feature collections as rows of JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """id, geometry type, coordinates and properties (JSON text) of every feature of the files of a path.

    A file is one JSON document and so one row; collections that outgrow that are read by read_feature_lines.
    """
    text = spark.read.text(path, wholetext=True)
    return _features(text.select(F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("feature")))


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from files with one feature per line, which Spark splits."""
    return _features(spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("feature")))


def _features(rows: DataFrame) -> DataFrame:
    get = lambda p: F.get_json_object("feature", f"$.{p}")
    return rows.select(get("id").alias("id"), get("geometry.type").alias("type"), get("geometry.coordinates").alias("coordinates"), get("properties").alias("properties"))
