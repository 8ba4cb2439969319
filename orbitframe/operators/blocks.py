"""Rasters as rows of blocks with overviews, and orthophoto tiles made from them.

A row is a block of one band: image, band, level, block_y, block_x, height, width and v, its values row by row.  Level 0
is the image, each further level halves it.  Written as Parquet sorted by image, level and block, a window reads the row
groups that its filters leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.operators import model_table
from orbitframe.operators.tiling import png

BLOCK = 256
SCHEMA = "image {kind}, band int, level int, block_y int, block_x int, height int, width int, v array<double>"
KEYS = ["image", "band", "level", "block_y", "block_x"]


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _rows(found: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=names)


def from_pixels(pixels: DataFrame, size: int = BLOCK, fill: float = 0.0) -> DataFrame:
    """Blocks of level 0 from rows image, band, x, y and v, one a pixel; pixels that are not there have the fill value.

    A block is as wide and high as its last pixel asks for.  Pixels outside of the first quadrant are left out.
    """
    placed = pixels.where("x >= 0 and y >= 0").select("image", F.col("band").cast("int").alias("band"), *(F.floor(F.col(a) / size).cast("int").alias(f"block_{a}") for a in "yx"), *((F.col(a) % size).cast("int").alias(a) for a in "yx"), F.col("v").cast("double").alias("v"))
    names = [*KEYS, "height", "width", "v"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        height, width = int(rows["y"].max()) + 1, int(rows["x"].max()) + 1
        out = np.full((height, width), fill)
        out[rows["y"], rows["x"]] = rows["v"]
        return _rows([(key[0], key[1], 0, key[2], key[3], height, width, out.ravel())], names)

    return placed.groupBy("image", "band", "block_y", "block_x").applyInPandas(run, SCHEMA.format(kind=_kind(pixels, "image")))


def whole_blocks(blocks: DataFrame, images: DataFrame, size: int = BLOCK, fill: float = 0.0) -> DataFrame:
    """Blocks cut or filled to their images' width and height (image, width, height), also where no pixel was."""
    bands = blocks.select("image", "band").distinct()
    last = lambda n: ((F.col(n) - 1) / size).cast("int")
    every = images.select("image", F.col("width").alias("_w"), F.col("height").alias("_h")).join(bands, "image")
    every = every.withColumn("block_y", F.explode(F.sequence(F.lit(0), last("_h")))).withColumn("block_x", F.explode(F.sequence(F.lit(0), last("_w"))))
    rows = every.join(blocks.where("level = 0"), ["image", "band", "block_y", "block_x"], "left")
    wide, high = (F.least(F.lit(size), F.col(n) - F.col(b) * size).cast("int") for n, b in (("_w", "block_x"), ("_h", "block_y")))

    @F.pandas_udf("array<double>")
    def fitted(v: pd.Series, height: pd.Series, width: pd.Series, to_height: pd.Series, to_width: pd.Series) -> pd.Series:
        out = []
        for values, h, w, th, tw in zip(v, height, width, to_height, to_width, strict=True):
            made = np.full((th, tw), fill)
            if values is not None:
                had = np.asarray(values, float).reshape(int(h), int(w))[:th, :tw]
                made[: had.shape[0], : had.shape[1]] = had
            out.append(made.ravel())
        return pd.Series(out)

    return rows.select("image", "band", F.lit(0).alias("level"), "block_y", "block_x", high.alias("height"), wide.alias("width"), fitted("v", "height", "width", high, wide).alias("v"))


def halved(v: np.ndarray) -> np.ndarray:
    """Means of two by two values; at an odd edge of what is there."""
    h, w = v.shape
    padded = np.pad(v, ((0, h % 2), (0, w % 2)), constant_values=np.nan).reshape((h + 1) // 2, 2, (w + 1) // 2, 2)
    known = ~np.isnan(padded)
    number = known.sum((1, 3))
    return np.where(number > 0, np.where(known, padded, 0).sum((1, 3)) / np.maximum(number, 1), np.nan)


def next_level(blocks: DataFrame, size: int = BLOCK) -> DataFrame:
    """The next overview of blocks of one level: four blocks at most become one."""
    names = [*KEYS, "height", "width", "v"]
    kind = _kind(blocks, "image")

    def small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [halved(np.asarray(v, float).reshape(h, w)) for v, h, w in zip(b["v"], b["height"], b["width"], strict=True)]
            yield b.assign(level=b["level"] + 1, height=[m.shape[0] for m in made], width=[m.shape[1] for m in made], v=[m.ravel() for m in made])[names]

    def joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        half = size // 2
        at = [((y % 2) * half, (x % 2) * half, h, w, v) for y, x, h, w, v in zip(rows["block_y"], rows["block_x"], rows["height"], rows["width"], rows["v"], strict=True)]
        height, width = max(y + h for y, _, h, _, _ in at), max(x + w for _, x, _, w, _ in at)
        out = np.full((height, width), np.nan)
        for y, x, h, w, v in at:
            out[y : y + h, x : x + w] = np.asarray(v, float).reshape(h, w)
        return _rows([(*key, height, width, out.ravel())], names)

    halves = blocks.select(*names).mapInPandas(small, SCHEMA.format(kind=kind))  # a quarter of the values is shuffled
    parents = [F.floor(F.col(f"block_{a}") / 2).cast("int").alias(f"parent_{a}") for a in "yx"]
    return halves.select("*", *parents).groupBy("image", "band", "level", "parent_y", "parent_x").applyInPandas(joined, SCHEMA.format(kind=kind))


def pyramid(blocks: DataFrame, levels: int, size: int = BLOCK) -> DataFrame:
    """Blocks of level 0 with so many overviews; sizes of blocks are even."""
    if size % 2:
        raise ValueError("blocks have an even number of rows and columns")
    out = here = blocks
    for _ in range(levels):
        here = next_level(here, size)
        out = out.unionByName(here)
    return out


def window(blocks: DataFrame, left: int, top: int, width: int, height: int, level: int = 0, bands: list[int] | None = None, size: int = BLOCK) -> DataFrame:
    """Blocks that hold a part of a window of a level, cut to it, with left and top in the level.  The bounds reach the scan as filters."""
    c = F.col
    rows = blocks.where((c("level") == level) & c("block_x").between(left // size, (left + width - 1) // size) & c("block_y").between(top // size, (top + height - 1) // size))
    rows = rows.where(c("band").isin(bands)) if bands else rows
    x0, y0 = F.greatest(c("block_x") * size, F.lit(left)), F.greatest(c("block_y") * size, F.lit(top))
    x1, y1 = F.least(c("block_x") * size + c("width"), F.lit(left + width)), F.least(c("block_y") * size + c("height"), F.lit(top + height))
    rows = rows.withColumns({"left": x0, "top": y0, "_x1": x1, "_y1": y1}).where("_x1 > left and _y1 > top")
    # the filter may come after this, so its bounds are kept sound
    lines = F.transform(F.sequence(c("top") - c("block_y") * size, F.greatest(c("_y1") - 1, c("top")) - c("block_y") * size), lambda y: F.slice("v", (y * c("width") + c("left") - c("block_x") * size + 1).cast("int"), F.greatest(c("_x1") - c("left"), F.lit(0)).cast("int")))
    rows = rows.withColumn("_v", F.flatten(lines))  # apart from the select, whose new width the lambda would take for the block's
    return rows.select("image", "band", "level", "left", "top", (c("_y1") - c("top")).alias("height"), (c("_x1") - c("left")).alias("width"), c("_v").alias("v"))


def to_pixels(windows: DataFrame) -> DataFrame:
    """image, band, x, y and v of the values of windows."""
    at = F.col("at")
    return windows.select("*", F.posexplode("v").alias("at", "value")).select("image", "band", (F.col("left") + at % F.col("width")).cast("int").alias("x"), (F.col("top") + F.floor(at / F.col("width"))).cast("int").alias("y"), F.col("value").alias("v"))


# Orthophoto tiles.

NODES = 3
BORDER = 2


def control_grids(tiles: DataFrame, images: DataFrame, table: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Tiles with gx and gy, the pixels of three by three places, the level to read and the window there; tiles without overlap are absent.

    tiles: keys, image, west, south, east and north in degrees.  images: image, width, height, overviews, and the
    elevation at which places are looked for.  table: the table of models.
    """
    c = F.col
    steps = F.sequence(F.lit(0), F.lit(NODES - 1))
    grid = tiles.select(*keys, "image", "west", "south", "east", "north").join(images.select("image", "elevation"), "image").withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    share = lambda n: F.col(n) / (NODES - 1)
    grid = grid.withColumns({"lon": c("west") + share("j") * (c("east") - c("west")), "lat": c("north") - share("i") * (c("north") - c("south"))})
    found = model_table.find_pixels(grid, table, "image", "lon", "lat", "elevation")
    nodes = F.array_sort(F.collect_list(F.struct("i", "j", "x", "y")))  # nine
    rows = found.groupBy(*keys, "image").agg(nodes.alias("nodes")).where(~F.exists("nodes", lambda n: n["x"].isNull() | n["y"].isNull() | F.isnan(n["x"]) | F.isnan(n["y"])))
    rows = rows.select(*keys, "image", F.col("nodes.x").alias("gx"), F.col("nodes.y").alias("gy")).join(images.select("image", c("width").alias("_w"), c("height").alias("_h"), "overviews"), "image")
    least, most = (lambda a: F.floor(F.array_min(f"g{a}"))), (lambda a: F.ceil(F.array_max(f"g{a}")))
    rows = rows.withColumns({"_x0": least("x"), "_y0": least("y"), "_x1": most("x"), "_y1": most("y")}).where("_x0 < _w and _y0 < _h and _x1 > 0 and _y1 > 0")
    side = F.least(c("_x1") - c("_x0"), c("_y1") - c("_y0"))
    rows = rows.withColumn("level", F.least(F.greatest(F.lit(0), F.floor(F.log2(F.greatest(side, F.lit(1)) / size))), c("overviews")).cast("int"))  # before clipping, so that tiles at the edge have their neighbours' level
    step = F.pow(F.lit(2.0), "level")
    rows = rows.withColumns({"_x0": F.greatest(c("_x0"), F.lit(0)), "_y0": F.greatest(c("_y0"), F.lit(0)), "_x1": F.least("_x1", "_w"), "_y1": F.least("_y1", "_h")})
    cut = {f"{a}{e}": F.floor(c(f"_{a}{e}") / step).cast("int") for a in "xy" for e in "01"}
    rows = rows.withColumns(cut).withColumns({f"{a}1": F.greatest(c(f"{a}1"), c(f"{a}0") + 1) for a in "xy"})
    inside = lambda a: F.transform(f"g{a}", lambda v: (v - c(f"_{a}0")) / step)
    return rows.select(*keys, "image", "level", "x0", "y0", "x1", "y1", inside("x").alias("gx"), inside("y").alias("gy"))


def bilinear_grid(nodes: np.ndarray, size: int) -> np.ndarray:
    """Values at size x size places of a grid of nodes that spans them."""
    at = np.linspace(0, NODES - 1, size)
    low = np.minimum(at.astype(int), NODES - 2)
    f = at - low
    rows = nodes[low] * (1 - f)[:, None] + nodes[low + 1] * f[:, None]
    return rows[:, low] * (1 - f) + rows[:, low + 1] * f


def remapped(source: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples of rows x columns x bands; edges are repeated over BORDER pixels, beyond it is 0."""
    wide = np.pad(np.pad(source, ((BORDER, BORDER), (BORDER, BORDER), (0, 0)), mode="edge"), ((1, 1), (1, 1), (0, 0)))
    h, w = wide.shape[:2]
    x, y = np.clip(x + BORDER + 1, 0, w - 1), np.clip(y + BORDER + 1, 0, h - 1)
    x0, y0 = np.minimum(x.astype(int), w - 2), np.minimum(y.astype(int), h - 2)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    return (wide[y0, x0] * (1 - fx) + wide[y0, x0 + 1] * fx) * (1 - fy) + (wide[y0 + 1, x0] * (1 - fx) + wide[y0 + 1, x0 + 1] * fx) * fy


#: Added before values are rounded to bytes, so that halves go the same way whatever the order of the sums.
TIE = 1.3e-6


def orthophotos(tiles: DataFrame, images: DataFrame, blocks: DataFrame, table: DataFrame, keys: list[str], size: int = 256, block: int = BLOCK, bands: list[int] | None = None) -> DataFrame:
    """keys and payload, a PNG with alpha, of the tiles that overlap their image.

    A tile costs nine calls of the image's model, and reads the blocks of its window at one level.  Values are bytes;
    those beyond are cut.  One band becomes grey; of more, three are shown.  A pixel is opaque where no band is 0.
    """
    grids = control_grids(tiles, images, table, keys, size)
    span = lambda a: F.explode(F.sequence(F.floor(F.col(f"{a}0") / block).cast("int"), F.floor((F.col(f"{a}1") - 1) / block).cast("int")))
    asked = grids.withColumn("block_y", span("y")).withColumn("block_x", span("x"))
    chosen = blocks.where(F.col("band").isin(bands)) if bands else blocks
    joined = asked.join(chosen, ["image", "level", "block_y", "block_x"])
    schema = ", ".join(f"`{k}` {_kind(tiles, k)}" for k in keys) + ", payload binary"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        x0, y0, x1, y1 = (int(first[n]) for n in ("x0", "y0", "x1", "y1"))
        order = {b: i for i, b in enumerate(sorted(rows["band"].unique())[:3])}
        source = np.zeros((y1 - y0, x1 - x0, len(order)))
        for band, by, bx, h, w, v in zip(rows["band"], rows["block_y"], rows["block_x"], rows["height"], rows["width"], rows["v"], strict=True):
            if band not in order:
                continue
            left, top = bx * block, by * block
            a, b, c, d = max(left, x0), max(top, y0), min(left + w, x1), min(top + h, y1)
            if c > a and d > b:
                source[b - y0 : d - y0, a - x0 : c - x0, order[band]] = np.asarray(v, float).reshape(h, w)[b - top : d - top, a - left : c - left]
        gx, gy = (bilinear_grid(np.asarray(first[n], float).reshape(NODES, NODES), size) for n in ("gx", "gy"))
        got = np.clip(np.floor(np.nan_to_num(remapped(source, gx, gy)) + 0.5 + TIE), 0, 255).astype(np.uint8)
        alpha = np.where((got != 0).all(2), 255, 0).astype(np.uint8)
        shown = np.repeat(got[..., :1], 3, 2) if got.shape[2] < 3 else got
        return pd.DataFrame([[*key, png(np.dstack([shown, alpha]))]], columns=[*keys, "payload"])

    return joined.groupBy(*keys).applyInPandas(run, schema)


def png_pixels(payload: bytes) -> np.ndarray:
    """Rows x columns x channels of a PNG that tiling.png wrote."""
    import struct
    import zlib

    width, height, _, kind = struct.unpack(">IIBB", payload[16:26])
    at, data = 8, b""
    while at < len(payload):
        (n,) = struct.unpack(">I", payload[at : at + 4])
        if payload[at + 4 : at + 8] == b"IDAT":
            data += payload[at + 8 : at + 8 + n]
        at += 12 + n
    channels = {0: 1, 4: 2, 2: 3, 6: 4}[kind]
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * channels)[:, 1:].reshape(height, width, channels)


def decoded(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, and the channels of the pixels of PNG payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pixels = png_pixels(batch.column(len(keys))[i].as_py())
                h, w, n = pixels.shape
                y, x = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
                channels = pa.ListArray.from_arrays(np.arange(0, h * w * n + 1, n, dtype=np.int32), pixels.ravel().astype(np.int32))
                same = [batch.column(k).take(pa.array(np.full(h * w, i))) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(y), pa.array(x), channels], [*keys, "y", "x", "channels"])

    return tiles.select(*keys, "payload").mapInArrow(run, ", ".join(f"`{k}` {_kind(tiles, k)}" for k in keys) + ", y int, x int, channels array<int>")

