"""Streams: the scalar and lookup operators are stateless, so they run on a stream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.functions import web_tiles as W


def tile_counts(events: DataFrame, zoom: int, time: str = "ts", window: str = "1 hour", late: str = "1 hour", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Events per tile and time window; on a stream, windows close when the watermark has passed them."""
    row, col = W.tile_of(F.col(lon), F.col(lat), F.lit(zoom))
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("during"), row.alias("row"), col.alias("col")).agg(F.count("*").alias("n"))
