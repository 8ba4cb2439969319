"""Web Mercator quad tiles; rows count from the south unless flip_y is asked for."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
SHIFT = math.pi * RADIUS


class TileSet(NamedTuple):
    name: str
    tile_size: int


#: Fixed names of the known tile sets.
TILE_SETS = {"WebMercatorQuad": TileSet("WebMercatorQuad", 256), "WebMercatorQuadx2": TileSet("WebMercatorQuadx2", 512)}


def tile_set(name: str) -> TileSet | None:
    return TILE_SETS.get(name)


def resolution(z: Column, size: int) -> Column:
    return F.lit(2 * SHIFT / size) / F.pow(F.lit(2.0), z)


def pixels_to_metres(px: Column, py: Column, z: Column, size: int) -> tuple[Column, Column]:
    return px * resolution(z, size) - SHIFT, py * resolution(z, size) - SHIFT


def metres_to_pixels(x: Column, y: Column, z: Column, size: int) -> tuple[Column, Column]:
    return (x + SHIFT) / resolution(z, size), (y + SHIFT) / resolution(z, size)


def pixels_to_tile(px: Column, py: Column, size: int) -> tuple[Column, Column]:
    """(column, row)."""
    return F.ceil(px / size) - 1, F.ceil(py / size) - 1


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.lit(RADIUS) * lon, F.lit(RADIUS) * F.log(F.tan(F.lit(math.pi / 4) + lat / 2))


def inverse_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return x / RADIUS, F.atan(F.sinh(y / RADIUS))


def tile_of(lon: Column, lat: Column, z: Column, size: int = 256, flip_y: bool = False) -> tuple[Column, Column]:
    """(row, column) of the tile that holds a place."""
    col, row = pixels_to_tile(*metres_to_pixels(*mercator(lon, lat), z, size), size)
    return (F.pow(F.lit(2.0), z) - 1 - row).cast("long") if flip_y else row.cast("long"), col.cast("long")


def tile_bounds_metres(z: Column, row: Column, col: Column, size: int = 256) -> tuple[Column, Column, Column, Column]:
    lo = pixels_to_metres(col * size, row * size, z, size)
    hi = pixels_to_metres((col + 1) * size, (row + 1) * size, z, size)
    return *lo, *hi


def tile_bounds(z: Column, row: Column, col: Column, size: int = 256) -> tuple[Column, Column, Column, Column]:
    """(west, south, east, north) in radians."""
    x0, y0, x1, y1 = tile_bounds_metres(z, row, col, size)
    return *inverse_mercator(x0, y0), *inverse_mercator(x1, y1)
