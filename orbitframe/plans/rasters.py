"""Block rasters with overviews, and orthophoto tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.operators import blocks, model_table
from orbitframe.plans.relations import PIX, cut, cut_sql, pix

#: Pixels of an image's side, of a block's and of a tile's.
SIDE, BLOCK, TILE = 32, 8, 8


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two images of one band, whose pixels are means; pixels without a mean are 0."""
    rows = pix(spark, sf_dir).groupBy((F.col("image") % 2).alias("image"), (F.col("x") % SIDE).alias("x"), (F.col("y") % SIDE).alias("y")).agg(F.avg("v").alias("v"))
    images = spark.range(2).select(F.col("id").alias("image"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"))
    level0 = blocks.from_pixels(rows.withColumn("band", F.lit(1)), BLOCK)
    return blocks.pyramid(blocks.whole_blocks(level0, images, BLOCK), 2, BLOCK)


def pixel_window_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of each of three levels, by image."""
    source, parts = mosaic(spark, sf_dir), None
    for level in range(3):
        got = blocks.to_pixels(blocks.window(source, 12 >> level, 5 >> level, 16 >> level, 20 >> level, level, size=BLOCK)).withColumn("level", F.lit(level))
        parts = got if parts is None else parts.unionByName(got)
    return parts.select("level", "image", "x", "y", cut(F.col("v") + 1.3e-7, 5).alias("v"))


def ortho_tile_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of PNG tiles over the two images, which are read at levels 0, 1 and 2."""
    k = F.col("id")
    wide = F.element_at(F.array(F.lit(8.4), F.lit(17.0), F.lit(33.5)), (k % 3 + 1).cast("int"))
    tiles = spark.range(12).select(k.alias("tile"), (k % 2).alias("image"), (k * 1.37 - 3).alias("west"), (k * 1.37 - 3 + wide).alias("east"), (33.3 - k * 0.9).alias("north"), (33.3 - k * 0.9 - wide).alias("south"))
    metadata = spark.range(2).select(k.alias("image"), F.array(*(F.lit(v) for v in (0.0, 1.0, 0.0, 32.0, 0.0, -1.0))).alias("geo_transform"))
    images = spark.range(2).select(k.alias("image"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), F.lit(2).alias("overviews"), F.lit(0.0).alias("elevation"))
    made = blocks.orthophotos(tiles, images, mosaic(spark, sf_dir), model_table.build(metadata, "image"), ["tile"], TILE, BLOCK)
    return blocks.decoded(made, ["tile"]).select("tile", "y", "x", F.col("channels")[0].alias("grey"), F.col("channels")[3].alias("alpha"))


_BASE = f"SELECT i.image, a.x, b.y, coalesce(p.v, 0.0::DOUBLE) AS v FROM (SELECT unnest(range(2)) AS image) i CROSS JOIN (SELECT unnest(range({SIDE})) AS x) a CROSS JOIN (SELECT unnest(range({SIDE})) AS y) b LEFT JOIN (SELECT image % 2 AS image, x % {SIDE} AS x, y % {SIDE} AS y, avg(v) AS v FROM ({PIX}) GROUP BY 1, 2, 3) p ON p.image = i.image AND p.x = a.x AND p.y = b.y"
_LEVELS = f"l0 AS ({_BASE}), l1 AS (SELECT image, x // 2 AS x, y // 2 AS y, avg(v) AS v FROM l0 GROUP BY 1, 2, 3), l2 AS (SELECT image, x // 2 AS x, y // 2 AS y, avg(v) AS v FROM l1 GROUP BY 1, 2, 3), p AS (SELECT 0 AS level, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2)"
_WINDOW = f"""WITH {_LEVELS} SELECT level, image, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, {cut_sql('v + 1.3e-7', 5)} AS v FROM p WHERE
(level = 0 AND x BETWEEN 12 AND 27 AND y BETWEEN 5 AND 24) OR (level = 1 AND x BETWEEN 6 AND 13 AND y BETWEEN 2 AND 11) OR (level = 2 AND x BETWEEN 3 AND 6 AND y BETWEEN 1 AND 5)"""
# A tile's pixel, its place in the image, in the level's window, and the four pixels of the window around it; the edge is repeated twice, beyond it is 0.
_ORTHO = f"""WITH {_LEVELS},
t AS (SELECT *, west + wide AS east, north - wide AS south FROM (SELECT tile, tile % 2 AS image, tile * 1.37::DOUBLE - 3 AS west, 33.3::DOUBLE - tile * 0.9::DOUBLE AS north, CASE tile % 3 WHEN 0 THEN 8.4::DOUBLE WHEN 1 THEN 17.0::DOUBLE ELSE 33.5::DOUBLE END AS wide FROM (SELECT unnest(range(12)) AS tile))),
b AS (SELECT *, floor(west) AS x0, ceil(east) AS x1, floor(32 - north) AS y0, ceil(32 - south) AS y1 FROM t),
c AS (SELECT tile, image, west, wide, north, CAST(least(2, greatest(0, floor(log2(least(x1 - x0, y1 - y0) / {TILE}.0::DOUBLE)))) AS INTEGER) AS level, greatest(x0, 0) AS x0, greatest(y0, 0) AS y0, least(x1, {SIDE}) AS x1, least(y1, {SIDE}) AS y1 FROM b WHERE x0 < {SIDE} AND y0 < {SIDE} AND x1 > 0 AND y1 > 0),
d AS (SELECT *, pow(2.0::DOUBLE, level) AS step FROM c),
e AS (SELECT *, floor(x0 / step) AS bx, floor(y0 / step) AS by_, greatest(floor(x1 / step), floor(x0 / step) + 1) - floor(x0 / step) AS wx, greatest(floor(y1 / step), floor(y0 / step) + 1) - floor(y0 / step) AS wy FROM d),
g AS (SELECT e.*, i.x, j.y, (west + i.x / {TILE - 1}.0::DOUBLE * wide - x0) / step AS sx, (32 - north + j.y / {TILE - 1}.0::DOUBLE * wide - y0) / step AS sy FROM e CROSS JOIN (SELECT unnest(range({TILE})) AS x) i CROSS JOIN (SELECT unnest(range({TILE})) AS y) j),
h AS (SELECT tile, image, x, y, level, bx, by_, wx, wy, greatest(-3.0::DOUBLE, least(sx, wx + 2.0)) AS sx, greatest(-3.0::DOUBLE, least(sy, wy + 2.0)) AS sy FROM g),
k AS (SELECT h.*, dx, dy, floor(sx) + dx AS px, floor(sy) + dy AS py, (CASE dx WHEN 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END) * (CASE dy WHEN 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END) AS w FROM h CROSS JOIN (SELECT unnest([0, 1]) AS dx) CROSS JOIN (SELECT unnest([0, 1]) AS dy)),
m AS (SELECT k.tile, k.x, k.y, sum(k.w * CASE WHEN px BETWEEN -2 AND wx + 1 AND py BETWEEN -2 AND wy + 1 THEN p.v ELSE 0 END) AS v FROM k JOIN p ON p.level = k.level AND p.image = k.image AND p.x = bx + greatest(0, least(wx - 1, px)) AND p.y = by_ + greatest(0, least(wy - 1, py)) GROUP BY 1, 2, 3)
SELECT tile, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(floor(v + 0.5::DOUBLE + {blocks.TIE}) AS INTEGER) AS grey, CASE WHEN floor(v + 0.5::DOUBLE + {blocks.TIE}) > 0 THEN 255 ELSE 0 END AS alpha FROM m"""

QUERIES = {"pixel_window_levels": pixel_window_levels, "ortho_tile_bytes": ortho_tile_bytes}
ORACLES = {"pixel_window_levels": _WINDOW, "ortho_tile_bytes": _ORTHO}
