"""Block rasters, overviews, windows and orthophoto tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.operators import blocks as K
from orbitframe.operators import model_table

SIZE = 4


def image(spark, width=11, height=9, bands=2, seed=1):
    values = np.random.default_rng(seed).integers(1, 250, (bands, height, width)).astype(float)
    rows = [(7, b + 1, x, y, float(values[b, y, x])) for b in range(bands) for y in range(height) for x in range(width)]
    return values, K.from_pixels(spark.createDataFrame(rows, "image long, band int, x int, y int, v double").repartition(3), SIZE)


def plain_levels(values, n):
    out = [values]
    for _ in range(n):
        out.append(K.halved(out[-1]))
    return out


def test_windows_of_all_levels_from_written_blocks(spark, tmp_path):
    values, level0 = image(spark)
    K.pyramid(level0, 2, SIZE).sort("image", "level", "block_y", "block_x").write.parquet(str(tmp_path / "blocks"))
    source = spark.read.parquet(str(tmp_path / "blocks"))
    for band in (1, 2):
        for level, want in enumerate(plain_levels(values[band - 1], 2)):
            h, w = want.shape
            for left, top, width, height in ((0, 0, w, h), (1, 1, 3, 2), (w - 2, h - 1, 9, 9), (50, 50, 3, 3)):
                got = {(r.x, r.y): r.v for r in K.to_pixels(K.window(source, left, top, width, height, level, [band], SIZE)).collect()}
                assert got == {(x, y): pytest.approx(want[y, x]) for y in range(top, min(top + height, h)) for x in range(left, min(left + width, w))}
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = K.window(source, 5, 5, 2, 2, 0, [1], SIZE)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(block_x,1)" in plan and "LessThanOrEqual(block_y,1)" in plan and "EqualTo(level,0)" in plan


def test_holes_and_missing_blocks(spark):
    level0 = K.from_pixels(spark.createDataFrame([(1, 1, 0, 0, 5.0), (1, 1, 9, 1, 7.0), (1, 1, -3, 0, 9.0)], "image int, band int, x int, y int, v double"), SIZE)
    sizes = spark.createDataFrame([(1, 10, 6)], "image int, width int, height int")
    got = {(r.x, r.y): r.v for r in K.to_pixels(K.window(K.whole_blocks(level0, sizes, SIZE), 0, 0, 99, 99, size=SIZE)).collect()}
    assert len(got) == 60 and got[0, 0] == 5 and got[9, 1] == 7 and sum(got.values()) == 12
    with pytest.raises(ValueError):
        K.pyramid(level0, 1, 3)
    assert K.pyramid(level0.limit(0), 1, SIZE).collect() == []


def test_halving_odd_sides():
    got = K.halved(np.array([[1.0, 3.0, 5.0], [np.nan, 5.0, 7.0], [2.0, 4.0, np.nan]]))
    assert got[0, 0] == 3 and got[0, 1] == 6 and got[1, 0] == 3 and np.isnan(got[1, 1])


def test_orthophotos(spark):
    values, level0 = image(spark, 16, 12, 3, 5)
    table = model_table.build(spark.createDataFrame([(7, [10.0, 0.5, 0.0, 40.0, 0.0, -0.5])], "image long, geo_transform array<double>"), "image")
    images = spark.createDataFrame([(7, 16, 12, 1, 0.0)], "image long, width int, height int, overviews int, elevation double")
    exact = (0, 7, 10.0, 40.0 - 7 * 0.5, 10.0 + 7 * 0.5, 40.0)  # its corner pixels are those of the image
    tiles = spark.createDataFrame([exact, (1, 7, 100.0, 10.0, 104.0, 14.0), (2, 7, 10.0, 33.0, 18.0, 41.0), (3, 8, 10.0, 36.0, 14.0, 40.0)], "tile int, image long, west double, south double, east double, north double")
    got = {r.tile: K.png_pixels(r.payload) for r in K.orthophotos(tiles, images, K.pyramid(level0, 1, SIZE), table, ["tile"], 8, SIZE).collect()}
    assert set(got) == {0, 2}  # no overlap, no model
    seen = np.pad(np.moveaxis(values[:, :7, :7], 0, 2), ((0, 1), (0, 1), (0, 0)), mode="edge")  # a window ends before its last place
    assert (got[0][..., :3] == seen).all() and (got[0][..., 3] == 255).all()
    half = np.stack([K.halved(v) for v in values], 2)
    nodes_x, nodes_y = np.linspace(0, 16, 8) / 2, np.linspace(-2, 14, 8) / 2  # level 1; the window begins at row 0
    want = K.remapped(half, *np.meshgrid(nodes_x, nodes_y))
    assert np.abs(got[2][..., :3] - want).max() <= 0.51
    rows = K.decoded(spark.createDataFrame([(0, None, K.png(np.arange(24).reshape(2, 3, 4)))], "tile int, x string, payload binary"), ["tile"]).collect()
    assert [(r.y, r.x, r.channels) for r in rows] == [(y, x, list(range(12 * y + 4 * x, 12 * y + 4 * x + 4))) for y in range(2) for x in range(3)]


def test_repeated_edge_and_what_is_beyond():
    source = np.full((3, 3, 1), 9.0)
    x, y = np.meshgrid([-2.0, -2.5, -4.0, 1.0, 4.0, 9.0], [1.0])
    assert K.remapped(source, x, y)[0, :, 0].tolist() == [9.0, 4.5, 0.0, 9.0, 9.0, 0.0]
