"""Raster headers and elevation grids from files that Spark lists and reads."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed tags of the public TIFF and GeoTIFF formats.
WIDTH, HEIGHT, PIXEL_SCALE, TIE_POINTS, TRANSFORM = 256, 257, 33550, 33922, 34264
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 12: 8, 16: 8}
_CODES = {3: "H", 4: "I", 12: "d", 16: "Q"}


def tiff_header(data: bytes) -> tuple[int | None, int | None, list[float] | None]:
    """Width, height and geotransform of a classic TIFF file's first directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        return None, None, None
    (at,) = struct.unpack(order + "I", data[4:8])
    found: dict[int, tuple] = {}
    if at + 2 > len(data):
        return None, None, None
    (n,) = struct.unpack(order + "H", data[at : at + 2])
    for i in range(n):
        entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
        if len(entry) < 12:
            break
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        size = _SIZES.get(kind, 1) * count
        raw = entry[8 : 8 + size] if size <= 4 else data[(p := struct.unpack(order + "I", entry[8:])[0]) : p + size]
        if kind in _CODES and len(raw) == size:
            found[tag] = struct.unpack(f"{order}{count}{_CODES[kind]}", raw)
    transform = None
    if TRANSFORM in found:
        m = found[TRANSFORM]
        transform = [m[3], m[0], m[1], m[7], m[4], m[5]]
    elif PIXEL_SCALE in found and TIE_POINTS in found:
        sx, sy = found[PIXEL_SCALE][:2]
        i, j, _, x, y, _ = found[TIE_POINTS][:6]
        transform = [x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy]
    return found.get(WIDTH, (None,))[0], found.get(HEIGHT, (None,))[0], transform


def read_tiff_headers(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """path, width, height, gt of the TIFF files of a path; others have nulls, or are an error if strict."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [tiff_header(x) for x in b["content"]]
            yield pd.DataFrame({"path": b["path"], "width": pd.array([r[0] for r in rows], "Int64"), "height": pd.array([r[1] for r in rows], "Int64"), "gt": [r[2] for r in rows]})

    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, width long, height long, gt array<double>")
    return out.withColumn("width", F.coalesce("width", F.raise_error(F.lit("unreadable raster")).cast("long"))) if strict else out


def read_ascii_grids(spark: SparkSession, path: str) -> DataFrame:
    """Elevation tiles of text grids (ncols, nrows, corner, cell size, no-data value, then rows from the north)."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.\w+$", 1).alias("tile_id"), "value")
    head = lambda n: F.regexp_extract("value", rf"(?im)^\s*{n}\s+([-+0-9.eE]+)", 1).try_cast("double")
    body = F.regexp_replace("value", r"(?im)^\s*[a-z_]+\s+[-+0-9.eE]+\s*$", "")
    z = F.transform(F.filter(F.split(F.trim(body), r"\s+"), lambda v: v != ""), lambda v: v.cast("double"))
    w, h, cell = head("ncols"), head("nrows"), head("cellsize")
    # a grid's corner is that of its lower left cell; posts stand at cell centres
    gt = F.array(head("xllcorner") + cell / 2, cell, F.lit(0.0), head("yllcorner") + cell * (h - 0.5), F.lit(0.0), -cell)
    return text.select("tile_id", w.cast("int").alias("width"), h.cast("int").alias("height"), gt.alias("gt"), z.alias("z"), F.coalesce(head("nodata_value"), F.lit(-9999.0)).alias("no_data"))


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Elevation tiles stored as Parquet, one row per tile."""
    return spark.read.parquet(path).select("tile_id", "width", "height", "gt", "z", "no_data")


def window(pixels: DataFrame, left: int, top: int, width: int, height: int, level: int = 0, bands: list[int] | None = None) -> DataFrame:
    """Pixels of a window of an overview level; the bounds reach the scan as filters."""
    c = F.col
    rows = pixels.where((c("r_level") == level) & c("x").between(left, left + width - 1) & c("y").between(top, top + height - 1))
    return rows.where(c("band").isin(bands)) if bands else rows
