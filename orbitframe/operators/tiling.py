"""Tile generators: pixel chips, encoded tiles and orthophoto resampling."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.functions import projective as M
from orbitframe.functions import web_tiles as W

BLOCK = 16  # pixels of a source block, which has one more row and column


def png(array: np.ndarray) -> bytes:
    """PNG of bytes, rows x columns (x 1 to 4 channels: gray, gray and alpha, colour, colour and alpha)."""
    array = np.atleast_3d(array).astype(np.uint8)
    h, w, n = array.shape
    raw = np.hstack([np.zeros((h, 1), np.uint8), array.reshape(h, w * n)]).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")


def encode_png(pixels: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys and payload from rows keys, x, y, bands (array of bytes); a tile has size squared pixels at most.

    Alpha is full where all bands differ from 0; missing pixels are transparent.
    """
    schema = ", ".join(f"`{k}` {pixels.schema[k].dataType.simpleString()}" for k in keys) + ", payload binary"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bands = np.stack(rows["bands"].to_numpy()).astype(np.uint8)
        if bands.shape[1] == 1:
            bands = np.repeat(bands, 3, axis=1)
        out = np.zeros((size, size, 4), np.uint8)
        out[rows["y"].to_numpy(), rows["x"].to_numpy()] = np.hstack([bands[:, :3], np.where((bands != 0).all(1), 255, 0).astype(np.uint8)[:, None]])
        return pd.DataFrame([[*key, png(out)]], columns=[*keys, "payload"])

    return pixels.groupBy(*keys).applyInPandas(run, schema)


def overview_level(min_side: Column, tile_width: int, overviews: Column) -> Column:
    """Level whose pixels are just finer than the tile's."""
    return F.least(F.greatest(F.lit(0), F.floor(F.log2(min_side / tile_width))), overviews).cast("int")


def tiles_for_area(area: DataFrame, key: str, zoom: int, size: int = 256) -> DataFrame:
    """All tiles that the places (lon, lat in radians) of each area span: key, row, col."""
    row, col = W.tile_of(F.col("lon"), F.col("lat"), F.lit(zoom), size)
    limits = area.select(key, row.alias("row"), col.alias("col")).groupBy(key).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    return limits.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1"))).select(key, "row", "col")


def orthophoto(tiles: DataFrame, pixels: DataFrame, image: str, keys: list[str], to_image, size: int = 256) -> DataFrame:
    """Bilinear samples of an image over geographic tiles: keys, x, y, v.

    tiles has keys, image and west, south, east, north in degrees; to_image(lon_deg, lat_deg) gives (x, y) columns of
    the source, whose pixels (image, x, y, v) stand once each.  The source is cut into blocks that share their last
    row and column with the next, so an output pixel asks for one block; output pixels without all four neighbours
    are absent.
    """
    steps = F.sequence(F.lit(0), F.lit(size - 1))
    grid = tiles.withColumn("y", F.explode(steps)).withColumn("x", F.explode(steps))
    lon = F.col("west") + (F.col("x") + 0.5) / size * (F.col("east") - F.col("west"))
    lat = F.col("north") - (F.col("y") + 0.5) / size * (F.col("north") - F.col("south"))
    sx, sy = to_image(lon, lat)
    grid = grid.withColumns({"_sx": sx, "_sy": sy}).withColumns({"_x0": F.floor("_sx"), "_y0": F.floor("_sy")})
    asked = grid.select(*keys, image, "x", "y", "_sx", "_sy", "_x0", "_y0", *(F.floor(F.col(f"_{a}0") / BLOCK).alias(f"_b{a}") for a in "xy"))
    homes = lambda a: F.explode(F.array_distinct(F.array(F.floor(F.col(a) / BLOCK), F.floor((F.col(a) - 1) / BLOCK))))  # noqa: E731  a first row or column is the block before's last as well
    place = lambda x, y: (y - F.col("_by") * BLOCK) * (BLOCK + 1) + x - F.col("_bx") * BLOCK
    source = pixels.select(image, F.col("x").alias("_px"), F.col("y").alias("_py"), "v").withColumn("_bx", homes("_px")).withColumn("_by", homes("_py"))
    blocks = source.groupBy(image, "_bx", "_by").agg(F.map_from_entries(F.collect_list(F.struct(place(F.col("_px"), F.col("_py")).cast("int").alias("k"), "v"))).alias("_posts"))  # a block's pixels at most
    joined = asked.join(blocks, [image, "_bx", "_by"])
    post = lambda dx, dy: F.try_element_at("_posts", place(F.col("_x0") + dx, F.col("_y0") + dy).cast("int"))
    fx, fy = F.col("_sx") - F.col("_x0"), F.col("_sy") - F.col("_y0")
    value = post(0, 0) * (1 - fx) * (1 - fy) + post(1, 0) * fx * (1 - fy) + post(0, 1) * (1 - fx) * fy + post(1, 1) * fx * fy
    return joined.select(*keys, "x", "y", value.alias("v")).where("v is not null")


def sidd_chip(left: Column, top: Column, width: Column, height: Column, old: Column | None = None) -> Column:
    """Struct of a chip's size and its corners in the original image; an earlier chip is composed.

    old: null, or a struct rows, cols and corners (array of structs col, row: UL, UR, LR, LL).
    """
    ends = [(left, top), (left + width - 1, top), (left + width - 1, top + height - 1), (left, top + height - 1)]
    made = []
    for x, y in ends:
        if old is not None:
            corners = [(old["corners"][i]["col"], old["corners"][i]["row"]) for i in range(4)]
            fx, fy = M.chip_to_full(x, y, old["cols"], old["rows"], corners)
            x, y = F.when(old.isNull(), x.cast("double")).otherwise(fx), F.when(old.isNull(), y.cast("double")).otherwise(fy)
        made.append(F.struct(x.cast("double").alias("col"), y.cast("double").alias("row")))
    return F.struct(height.alias("rows"), width.alias("cols"), F.array(*made).alias("corners"))
