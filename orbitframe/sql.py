"""Scalar operators as temporary SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bodies are plain SQL, so calls are inlined into the plan like any expression.
FUNCTIONS = {
    "of_tile_row(lon DOUBLE, lat DOUBLE, z INT, size INT) RETURNS BIGINT": "CAST(ceil((6378137.0D * ln(tan(pi() / 4 + lat / 2)) + pi() * 6378137.0D) / (2 * pi() * 6378137.0D / size / power(2D, z)) / size) - 1 AS BIGINT)",
    "of_tile_col(lon DOUBLE, z INT, size INT) RETURNS BIGINT": "CAST(ceil((6378137.0D * lon + pi() * 6378137.0D) / (2 * pi() * 6378137.0D / size / power(2D, z)) / size) - 1 AS BIGINT)",
    "of_power(i DOUBLE, q DOUBLE) RETURNS DOUBLE": "i * i + q * q",
    "of_decibels(p DOUBLE) RETURNS DOUBLE": "CASE WHEN p = 0 THEN double('-Infinity') ELSE 10 * log10(p) END",
    "of_normalize(v DOUBLE, o DOUBLE, s DOUBLE) RETURNS DOUBLE": "(v - o) / s",
    "of_denormalize(v DOUBLE, o DOUBLE, s DOUBLE) RETURNS DOUBLE": "v * s + o",
    "of_box_distance(ax0 DOUBLE, ay0 DOUBLE, ax1 DOUBLE, ay1 DOUBLE, bx0 DOUBLE, by0 DOUBLE, bx1 DOUBLE, by1 DOUBLE) RETURNS DOUBLE": "sqrt(power(greatest(0D, ax0 - bx1, bx0 - ax1), 2) + power(greatest(0D, ay0 - by1, by0 - ay1), 2))",
}


def register(spark: SparkSession) -> None:
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
