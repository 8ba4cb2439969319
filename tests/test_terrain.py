"""Terrain met by contours: bounds of blocks, and what they rule out."""

import numpy as np
from pyspark.sql import functions as F

from orbitframe.functions import geodesy as G
from orbitframe.operators import elevation as E
from orbitframe.operators import sar
from orbitframe.operators import terrain as T
from orbitframe.plans import sar_images


def tile(spark, z, width=40, height=33):
    values = [float(z(r, c)) for r in range(height) for c in range(width)]
    return spark.createDataFrame([("t", width, height, [0.0, 0.01, 0.0, 1.0, 0.0, -0.01], values, -9999.0)], "tile_id string, width int, height int, gt array<double>, z array<double>, no_data double")


def test_bounds_hold_around_each_block(spark):
    z = lambda r, c: -9999.0 if (r, c) == (3, 3) else 10 * r + c
    bounds = {(r.level, r.brow, r.bcol): (r.least, r.most) for r in T.height_bounds(E.cut_blocks(tile(spark, z), 8), 3).collect()}
    for level in range(3):
        step = 8 << level
        for (at, row, col), (least, most) in bounds.items():
            if at != level or not (0 <= row * step < 33 and 0 <= col * step < 40):
                continue
            near = [z(r, c) for r in range(max(0, (row - 1) * step), min(33, (row + 2) * step + 1)) for c in range(max(0, (col - 1) * step), min(40, (col + 2) * step + 1)) if z(r, c) > -9999]
            assert least <= min(near) and most >= max(near), (level, row, col)


def test_sections_outside_of_the_bounds_go(spark):
    tiles = tile(spark, lambda r, c: 100.0 if c < 20 else 900.0)
    blocks = E.cut_blocks(tiles, 8)
    at = lambda lon, low, high: (lon, 0.9, low, lon + 0.001, 0.9, high)
    rows = [(1, *at(0.02, 90.0, 99.0)), (2, *at(0.02, 99.0, 101.0)), (3, *at(0.02, 500.0, 600.0)), (4, *at(0.17, 500.0, 600.0)), (5, *at(0.36, 100.0, 200.0)), (6, *at(0.36, 890.0, 910.0))]
    df = spark.createDataFrame(rows, "id int, _lon0 double, _lat0 double, _h0 double, _lon1 double, _lat1 double, _h1 double")
    kept = T._may_meet(df, T.height_bounds(blocks, 4), tiles, lambda lon, lat: F.lit("t"), 4, 8)
    assert sorted(r.id for r in kept.collect()) == [2, 4, 6]  # 4 lies where the cliff is near
    none = T._may_meet(df, T.height_bounds(blocks, 4), tiles, lambda lon, lat: F.lit("other"), 4, 8)
    assert none.collect() == []


def _flown(n=60):
    """Tracks of a straight pass at 500 km, which rise from 0 to some 300 m on their way north, and their first latitude."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        rad, y = 700_000 + rng.uniform(-60, 60), rng.uniform(-700, 700)
        place = lambda cos: np.array([[G.A + 500_000 - rad * cos, y, rad * np.sqrt(1 - cos * cos)]])  # noqa: E731, B023
        low, high = 0.7, 0.8
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if sar._geodetic(place(mid))[2][0] > 0 else (low, mid)
        step = -sar.CONTOUR_STEP * np.sqrt(1 - low * low) / rad
        rows.append((i, "L", G.A + 500_000, y, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0, rad, low, float(step), 42))
    return rows, float(np.degrees(sar._geodetic(place(low))[1][0]))


def _plainly(track, tiles, name, post_step):
    """The first meeting of one track by every step."""
    _, _, cx, cy, cz, *_, rad, cb, step, n = track
    place = lambda cos: np.array([[cx - rad * cos, cy, cz + rad * np.sqrt(1 - cos * cos)]])

    def above(cos):
        lon, lat, h = (v[0] for v in sar._geodetic(place(cos)))
        t = tiles.get(name(np.degrees(lon), np.degrees(lat)))
        if t is None:
            return None
        west, north, z = t
        x, y = np.clip((np.degrees(lon) - west) / post_step, 0, z.shape[1] - 1), np.clip((north - np.degrees(lat)) / post_step, 0, z.shape[0] - 1)
        c, r = min(int(x), z.shape[1] - 2), min(int(y), z.shape[0] - 2)
        part, fx, fy = z[r : r + 2, c : c + 2], x - c, y - r
        if (part == -9999).any():
            return None
        return h - ((part[0, 0] * (1 - fx) + part[0, 1] * fx) * (1 - fy) + (part[1, 0] * (1 - fx) + part[1, 1] * fx) * fy)

    d = [above(cb + i * step) for i in range(n + 1)]
    for i in range(n):
        if d[i] is None or d[i + 1] is None or d[i] * d[i + 1] >= 0:
            continue
        c0, c1, d0, d1 = cb + i * step, cb + (i + 1) * step, d[i], d[i + 1]
        for _ in range(T.ROUNDS):
            cm = c0 + d0 / (d0 - d1) * (c1 - c0)
            dm = above(cm)
            if dm is None:
                return None
            c0, d0, c1, d1 = (cm, dm, c1, d1) if np.sign(dm) == np.sign(d0) else (c0, d0, cm, dm)
        return tuple(place(c0 + d0 / (d0 - d1) * (c1 - c0))[0])
    return None


def test_meetings_are_those_of_every_step_and_steps_in_one_block_are_no_rows(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows, lat = _flown()
    middle, post_step = lat + 0.0012, 0.0004
    tiles = {}
    for name, north in (("s", middle), ("n", middle + 0.006)):
        z = rng.uniform(40, 260, (16, 45))
        z[rng.random(z.shape) < 0.04] = -9999.0
        tiles[name] = (-0.0088, north, z)
    begins = middle - 0.0011  # south of it there is no tile, so that contours begin without elevation
    name = lambda _, at: "n" if at > middle else "s" if at > begins else "none"
    sheets = spark.createDataFrame([(k, 45, 16, [w, post_step, 0.0, n, 0.0, -post_step], [float(v) for v in z.ravel()], -9999.0) for k, (w, n, z) in tiles.items()], "tile_id string, width int, height int, gt array<double>, z array<double>, no_data double")
    tracks = spark.createDataFrame(rows, "id long, look string, " + ", ".join(f"{n} {'int' if n == '_n' else 'double'}" for n in sar.TRACK))
    counts, kept = [], T.written
    monkeypatch.setattr(T, "written", lambda df: (out := kept(df), counts.append(out.count()))[0])
    got = T.meet_terrain(tracks, "id", "look", sheets, lambda _, at: F.when(at > middle, "n").when(at > begins, "s").otherwise("none"), 2, 8)
    got = {r.id: tuple(r.point) for r in got.collect()}
    want = {t[0]: p for t in rows if (p := _plainly(t, tiles, name, post_step)) is not None}
    assert got.keys() == want.keys() and 20 < len(want) < 60
    assert all(np.allclose(got[k], want[k], rtol=0, atol=1e-4) for k in want)
    # all go from no tile to one and most to the next, yet of 42 steps each only those of the borders become rows
    assert counts[0] == len(rows) and sum(counts[1:]) < 15 * len(rows), counts


def test_pixels_are_not_sent_to_the_pieces_of_their_models(spark):
    pixels = spark.range(100_000).selectExpr("id", "id % 4 AS image_id", "1.0D * id AS x", "2.0D * id AS y").repartition(13)
    assert sar.contours(pixels, sar_images._images(spark)).rdd.getNumPartitions() == 13
