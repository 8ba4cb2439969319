"""Elevation as lookup joins: tile ids, grids cut into blocks, bilinear samples and chains of providers.

A raster tile can hold millions of posts, so it is never joined to a point whole.  Tiles are cut once into small
overlapping blocks; a point's join key names the one block that holds its four posts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.functions import geodesy as G
from orbitframe.functions.projective import affine_inverse

BLOCK = 16
#: Fixed description of a constant model: no-data value and post spacing in metres.
CONSTANT_NO_DATA, CONSTANT_SPACING = -32767.0, 30.0


def srtm_tile_id(lon: Column, lat: Column, prefix: str = "", version: str = "1arc_v3", suffix: str = ".tif") -> Column:
    """Name of the one-degree tile with the place; null outside 56 south to 59 north."""
    x, y = F.floor(F.degrees(lon)), F.floor(F.degrees(lat))
    part = lambda v, width, plus, minus: F.concat(F.when(v < 0, F.lit(minus)).otherwise(F.lit(plus)), F.lpad(F.abs(v).cast("string"), width, "0"))
    return F.when((y >= -56) & (y <= 59), F.concat(F.lit(prefix), part(y, 2, "n", "s"), F.lit("_"), part(x, 3, "e", "w"), F.lit(f"_{version}{suffix}")))


def tile_id(spec: str, lon: Column, lat: Column, lon_bounds: tuple[int, int] = (-180, 180), lat_bounds: tuple[int, int] = (-90, 90)) -> Column:
    """Name of the one-degree tile by a coordinate format; null outside the bounds, which are inclusive."""
    x, y = F.floor(F.degrees(lon)), F.floor(F.degrees(lat))
    name = G.format_coordinate(spec, F.radians(x.cast("double")), F.radians(y.cast("double")), F.lit(0.0))
    return F.when(x.between(*lon_bounds) & y.between(*lat_bounds), name)


def cut_blocks(tiles: DataFrame, size: int = BLOCK, reach: int | None = None) -> DataFrame:
    """Blocks (tile_id, brow, bcol, …) of tiles (tile_id, width, height, gt, z, no_data); each shares its last row and column with the next.

    With reach, blocks still begin every size posts but go as many posts on as it says.
    """
    reach = size if reach is None else reach
    c = F.col
    rows = F.explode(F.sequence(F.lit(0), F.floor((F.greatest(c("height"), F.lit(2)) - 2) / size).cast("int")))
    cols = F.explode(F.sequence(F.lit(0), F.floor((F.greatest(c("width"), F.lit(2)) - 2) / size).cast("int")))
    cut = tiles.withColumn("brow", rows).withColumn("bcol", cols)
    r0, c0 = c("brow") * size, c("bcol") * size
    r1, n = F.least(r0 + reach, c("height") - 1), F.least(F.lit(reach + 1), c("width") - c("bcol") * size)
    posts = F.flatten(F.transform(F.sequence(r0, r1), lambda r: F.slice("z", r * c("width") + c0 + 1, n)))
    return cut.select("tile_id", "brow", "bcol", "width", "height", "gt", "no_data", n.alias("block_width"), posts.alias("posts"))


def sample(points: DataFrame, blocks: DataFrame, headers: DataFrame, lon: str = "lon_deg", lat: str = "lat_deg", key: str = "tile_id", out: str = "sampled", size: int = BLOCK) -> DataFrame:
    """Points with the bilinear elevation of their tile, null where there is no tile or a post without data.

    headers has tile_id, width, height and gt of each tile.  Places beyond a tile's outer posts take the edge's value.
    """
    c = F.col
    head = headers.select(F.col("tile_id").alias(key), F.col("gt").alias("_gt"), F.col("width").alias("_w"), F.col("height").alias("_h"))
    x, y = affine_inverse(c("_gt"), c(lon), c(lat))
    inside = lambda v, n: F.greatest(F.lit(0.0), F.least(v, (n - 1).cast("double")))
    placed = points.join(head, key, "left").withColumns({"_x": inside(x, c("_w")), "_y": inside(y, c("_h"))})
    first = lambda v, n: F.greatest(F.lit(0), F.least(F.floor(v).cast("int"), n - 2))
    placed = placed.withColumns({"_c": first(c("_x"), c("_w")), "_r": first(c("_y"), c("_h"))})
    placed = placed.withColumns({"_bc": F.floor(c("_c") / size).cast("int"), "_br": F.floor(c("_r") / size).cast("int")})
    part = blocks.select(F.col("tile_id").alias(key), F.col("brow").alias("_br"), F.col("bcol").alias("_bc"), "block_width", "posts", "no_data")
    joined = placed.join(part, [key, "_br", "_bc"], "left")
    post = lambda dr, dc: F.nullif(F.try_element_at("posts", ((c("_r") + dr - c("_br") * size) * c("block_width") + c("_c") + dc - c("_bc") * size + 1).cast("int")), c("no_data"))
    fx, fy = c("_x") - c("_c"), c("_y") - c("_r")

    def mixed(a: Column, b: Column, f: Column) -> Column:
        """A post that has no weight is not asked for."""
        return F.when(f == 0, a).when(f == 1, b).otherwise(a * (1 - f) + b * f)

    value = mixed(mixed(post(0, 0), post(0, 1), fx), mixed(post(1, 0), post(1, 1), fx), fy)
    return joined.withColumn(out, value).select(*points.columns, out)


def offset_tiles(tiles: DataFrame, scale: float = 1.0) -> DataFrame:
    """Offset rasters for cut_blocks and sample: values in metres by a scale factor, posts at the pixels' centres.

    Axes may run either way; a rotated raster is an error.
    """
    gt = F.col("gt")
    moved = F.array(gt[0] + gt[1] / 2, gt[1], F.lit(0.0), gt[3] + gt[5] / 2, F.lit(0.0), gt[5])
    checked_gt = F.when((gt[2] == 0) & (gt[4] == 0), moved).otherwise(F.raise_error(F.lit("an offset grid must not be rotated")).cast("array<double>"))
    return tiles.withColumns({"gt": checked_gt, "z": F.transform("z", lambda v: F.when(v.eqNullSafe(F.col("no_data")), v).otherwise(v * scale))})


def at_normalized(points: DataFrame, look_up, lon: str = "lon_deg", lat: str = "lat_deg") -> DataFrame:
    """What look_up finds for the places' longitudes and latitudes brought into their usual ranges; the places stay as they are.

    look_up(df) reads the columns norm_lon_deg and norm_lat_deg and adds its own.
    """
    x, y = G.normalized(F.radians(lon), F.radians(lat))
    return look_up(points.withColumns({"norm_lon_deg": F.degrees(x), "norm_lat_deg": F.degrees(y)})).drop("norm_lon_deg", "norm_lat_deg")


def set_elevation(points: DataFrame, value: Column, elev: str = "elev", found: str = "found") -> DataFrame:
    """Elevation replaced where there is a value, else kept; found says which."""
    return points.withColumns({elev: F.coalesce(value, F.col(elev)), found: value.isNotNull()})


def first_of(*values: Column) -> Column:
    """The first provider with a value."""
    return F.coalesce(*values)


def when(condition: Column, value: Column) -> Column:
    """A provider that holds only where a condition does."""
    return F.when(F.coalesce(condition, F.lit(False)), value)


def plus(value: Column, offset: Column) -> Column:
    """A provider moved by an offset."""
    return value + offset


def checked(lon_deg: Column, lat_deg: Column, value: Column, slack: float = 1e-9) -> Column:
    """An offset's value; an error beyond the poles or the date line."""
    good = (F.abs(lat_deg) <= 90 + slack) & (F.abs(lon_deg) <= 180 + slack)
    return F.when(good, value).otherwise(F.raise_error(F.lit("coordinate outside the offset grid")).cast("double"))


def constant_summary(value: float) -> Column:
    return F.struct(F.lit(value).alias("min_z"), F.lit(value).alias("max_z"), F.lit(CONSTANT_NO_DATA).alias("no_data"), F.lit(CONSTANT_SPACING).alias("post_spacing"))


def summaries(tiles: DataFrame) -> DataFrame:
    """min_z, max_z, no_data and post_spacing of each tile; the spacing is the ECEF diagonal over the pixel diagonal."""
    c = F.col
    good = F.filter("z", lambda v: v.isNotNull() & ~v.eqNullSafe(c("no_data")))
    corner = lambda i, j: G.geodetic_to_ecef(F.radians(c("gt")[0] + c("gt")[1] * i + c("gt")[2] * j), F.radians(c("gt")[3] + c("gt")[4] * i + c("gt")[5] * j), F.lit(0.0))
    a, b = corner(F.lit(0), F.lit(0)), corner(c("width"), c("height"))
    ground = F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a, b, strict=True)), F.lit(0.0)))
    pixels = F.sqrt((c("width") * c("width") + c("height") * c("height")).cast("double"))
    return tiles.select("tile_id", F.array_min(good).alias("min_z"), F.array_max(good).alias("max_z"), "no_data", (ground / pixels).alias("post_spacing"))
