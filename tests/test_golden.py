"""Known values of single operators."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.functions import geodesy as G
from orbitframe.functions import polynomials as P
from orbitframe.functions import projective as M
from orbitframe.functions import radiometry as R
from orbitframe.functions import sar_geometry as S
from orbitframe.functions import text as T
from orbitframe.functions import web_tiles as W
from orbitframe.operators import elevation as E
from orbitframe.operators import features as FE
from orbitframe.operators import models, sar, spatial, statistics, tiling
from orbitframe.plans import geodesy, sar_images
from orbitframe.sources import products


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def deg(lon, lat):
    return F.lit(math.radians(lon)), F.lit(math.radians(lat))


def test_dms(spark):
    assert one(spark, G.dms(*deg(-121.5125, -10.5125)))[0] == "103045S1213045W"


def test_format_directives(spark):
    text = G.format_coordinate("%% %lh%oh %od-%q%E", *deg(-7.5, 3.25), F.lit(12.0))
    assert one(spark, text)[0] == "% nw 007-12.0"


def test_normalized(spark):
    lon, lat = G.normalized(*deg(-700, -91))
    assert one(spark, F.degrees(lon), F.degrees(lat)) == pytest.approx((-160, -89))


def test_range_adjusted(spark):
    r = math.radians
    got = one(spark, G.range_adjusted(*deg(181, 179), r(360), r(720), r(-270), r(-180)))[0]
    assert (math.degrees(got.lon), math.degrees(got.lat)) == pytest.approx((541, -181))
    assert one(spark, G.range_adjusted(*deg(10, 10), r(20), r(30), r(20), r(30)))[0] is None


def test_ecef_and_back(spark):
    x, y, z = G.geodetic_to_ecef(*deg(5, 10), F.lit(0.0))
    assert one(spark, x, y, z) == pytest.approx((6257968, 547501, 1100249), abs=1)
    for lon, lat, h in ((5, 10, 0), (-170, -89.9999, 8000), (0, 90, 5)):
        back = G.ecef_to_geodetic(*G.geodetic_to_ecef(*deg(lon, lat), F.lit(float(h))))
        row = one(spark, *back)
        assert (math.degrees(row[1]), row[2]) == pytest.approx((lat, h), abs=1e-6)


def test_tile_ids(spark):
    assert one(spark, E.srtm_tile_id(*deg(142.3, 3.7)), E.srtm_tile_id(*deg(-1.5, -10.5)), E.srtm_tile_id(*deg(0.5, 61.5))) == ("n03_e142_1arc_v3.tif", "s11_w002_1arc_v3.tif", None)
    assert one(spark, E.tile_id("dted/%oh%od/%lh%ld.dt2", *deg(-43.648601, -22.999056)))[0] == "dted/w044/s23.dt2"


def grid(spark, no_data):
    z = [0.0, 1.0, 4.0, 1.0, 2.0, 3.0, 2.0, 3.0, -9999.0 if no_data else 4.0]
    return spark.createDataFrame([("t", 3, 3, [0.0, 1.0, 0.0, 0.0, 0.0, 1.0], z, -9999.0)], "tile_id string, width int, height int, gt array<double>, z array<double>, no_data double")


@pytest.mark.parametrize("size", [1, 16])
def test_bilinear(spark, size):
    tiles = grid(spark, False)
    points = spark.createDataFrame([(1.5, 0.0, "t"), (-1.0, -1.0, "t"), (2.5, 2.5, "t"), (0.0, 0.0, "none")], "lon_deg double, lat_deg double, tile_id string")
    got = {(r.lon_deg, r.lat_deg): r.sampled for r in E.sample(points, E.cut_blocks(tiles, size), tiles, size=size).collect()}
    assert got == {(1.5, 0.0): 2.5, (-1.0, -1.0): 0.0, (2.5, 2.5): 4.0, (0.0, 0.0): None}


def test_no_data_keeps_elevation(spark):
    tiles = grid(spark, True)
    points = spark.createDataFrame([(1.0 + 0.5, 1.5, "t", 7.0)], "lon_deg double, lat_deg double, tile_id string, elev double")
    row = E.set_elevation(E.sample(points, E.cut_blocks(tiles), tiles), F.col("sampled")).first()
    assert (row.elev, row.found) == (7.0, False)
    s = E.summaries(tiles).first()
    assert (s.min_z, s.max_z, s.no_data) == (0.0, 4.0, -9999.0)


def test_web_tiles(spark):
    assert one(spark, *W.tile_of(F.lit(2.113), F.lit(0.395), F.lit(10))) == (578, 856)
    assert one(spark, *W.tile_bounds(F.lit(10), F.lit(578), F.lit(856))) == pytest.approx((2.1107576, 0.3943349, 2.1168935, 0.3999932), abs=1e-7)
    assert W.tile_set("WebMercatorQuadx2").tile_size == 512 and W.tile_set("other") is None


def test_chip_homography(spark):
    corners = [(10, 10, 0, 0), (20, 10, 5, 0), (20, 20, 5, 5), (10, 20, 0, 5)]
    points = spark.createDataFrame([(0, *map(float, c)) for c in corners], "image int, fx double, fy double, cx double, cy double")
    h = statistics.fit_homography(points, "image", ("fx", "fy"), ("cx", "cy"))
    x, y = models.through_chip([F.col("h")[i] for i in range(8)], F.lit(2.0), F.lit(2.0))
    assert h.select(x, y).first() == pytest.approx((14, 14))
    assert statistics.fit_homography(points.limit(3), "image", ("fx", "fy"), ("cx", "cy")).count() == 0


def test_stretches(spark):
    v = spark.createDataFrame([(float(i),) for i in (10, 20, 30, 40, 50, 60)], "v double")
    assert [r[0] for r in v.select(R.minmax_byte(F.col("v"), F.lit(10.0), F.lit(60.0))).collect()] == [0, 42, 85, 127, 170, 212]
    v = spark.createDataFrame([(float(i),) for i in (50, 75, 100, 125, 150, 175)], "v double")
    assert [r[0] for r in v.select(R.dra_byte(F.col("v"), F.lit(35.0), F.lit(205.0))).collect()][0] == 22
    same = spark.createDataFrame([(1, 42.0)] * 3, "g int, v double")
    assert {r.display for r in statistics.stretched(same, ["g"]).collect()} == {0.5}
    assert one(spark, R.decibels(F.lit(0.0)), R.decibels(F.lit(100.0))) == (-math.inf, 20.0)


def test_amplitude_table(spark):
    lut = F.array(*(F.lit(float(i)) for i in range(10, 19)))
    rows = spark.range(9).select(R.to_complex(F.col("id"), F.lit(256), F.lit("AMP8I_PHS8I"), lut).alias("z")).collect()
    assert [r.z.i for r in rows] == pytest.approx(list(range(10, 19))) and [r.z.q for r in rows] == pytest.approx([0] * 9, abs=1e-12)
    with pytest.raises(Exception, match="unknown pixel type"):
        spark.range(1).select(R.to_complex(F.col("id"), F.lit(1), F.lit("X"), lut)).collect()


def test_dra_histogram(spark):
    counts = [(0, i, 1 if 1 <= i <= 98 or i == 1022 else 200 if 100 <= i <= 399 else 0) for i in range(1024)]
    row = statistics.dra_parameters(spark.createDataFrame(counts, "image int, bin int, n long"), ["image"], 1024).first()
    assert (row.lo, row.hi) == pytest.approx((47, 506), abs=1) and (row.actual_lo, row.actual_hi) == (1, 1022)


def test_spatial_index(spark):
    boxes = spark.createDataFrame([(3 * i + j, 10.0 * i, 10.0 * j, 10.0 * i + 5, 10.0 * j + 5) for i in range(3) for j in range(3)], "id int, xmin double, ymin double, xmax double, ymax double")
    query = lambda *b: spark.createDataFrame([(0, *map(float, b))], "id int, xmin double, ymin double, xmax double, ymax double")
    assert spatial.find_intersects(boxes, query(-1, -1, 11, 11), 7.0).count() == 4
    assert spatial.find_intersects(boxes, query(-1, -1, 31, 31), 7.0).count() == 9
    assert spatial.find_nearest(boxes, query(1, 1, 1, 1), "id", 5.0).count() == 1
    assert spatial.find_nearest(boxes, query(7.5, 7.5, 7.5, 7.5), "id", 5.0).count() == 4
    assert spatial.find_nearest(boxes, query(100, 100, 100, 100), "id", 5.0).count() == 0


def test_clip(spark):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-1.0, -1.0), (3.0, -1.0), (3.0, 3.0), (-1.0, 3.0), (-1.0, -1.0))))
    got = one(spark, spatial.clip_box(ring, 0.0, 0.0, 2.0, 2.0))[0]
    assert {(p.x, p.y) for p in got} == {(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)} and got[0] == got[-1]
    assert one(spark, spatial.clip_box(ring, 5.0, 5.0, 6.0, 6.0))[0] == []


def test_geometries_by_cell(spark):
    """Collections of any depth are flattened, and each part is cut to the cells that it touches."""
    square = lambda x, y, w: [[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]
    polygon = {"type": "Polygon", "coordinates": [square(0.25, 0.25, 1.5)]}
    several = {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [0, 0]}, {"type": "GeometryCollection", "geometries": [{"type": "MultiPolygon", "coordinates": [[square(5.25, 5.25, 0.5)], [square(7.25, -3.75, 0.5)]]}]}]}
    rows = spark.createDataFrame([("a", json.dumps(polygon)), ("b", json.dumps(several)), ("c", '{"type":"Point","coordinates":[1,2]}'), ("d", None)], "id string, geometry string")
    got = {(r.id, r.part, r.cell_x, r.cell_y): r.rings for r in spatial.cell_geometries(rows).collect()}
    assert set(got) == {("a", 0, x, y) for x in (0, 1) for y in (0, 1)} | {("b", 0, 5, 5), ("b", 1, 7, -4)}
    assert {(p.x, p.y) for p in got["a", 0, 1, 0][0]} == {(1.0, 0.25), (1.75, 0.25), (1.75, 1.0), (1.0, 1.0)}


def test_extensions(spark):
    names = F.array(F.lit("tif"), F.lit("tiff"))
    assert one(spark, T.image_extension(F.lit("scenes/tif_of_may.tiff"), names), T.select_extension(F.lit("a"), F.array().cast("array<string>"))) == ("TIFF", "UNKNOWN")


def test_polynomials(spark):
    c = F.array(*(F.lit(float(i)) for i in (1, 2, 3)))
    assert one(spark, P.horner(c, F.lit(2.0)), P.horner(P.derivative(c), F.lit(2.0)), P.horner(P.derivative(c, 3), F.lit(2.0))) == (17.0, 14.0, 0.0)
    pairs = F.array(F.struct(F.lit(2).alias("exponent"), F.lit(5.0).alias("value")))
    assert one(spark, P.dense(pairs, F.lit(3)))[0] == [0.0, 0.0, 5.0, 0.0]
    with pytest.raises(Exception, match="wrong number"):
        spark.range(1).select(P.rsm(c, 1, 1, 1, F.lit(1.0), F.lit(1.0), F.lit(1.0))).collect()
    assert one(spark, *M.affine_inverse(F.array(*(F.lit(0.0) for _ in range(6))), F.lit(1.0), F.lit(1.0))) == (None, None)


def test_model_choice(spark):
    rows = spark.createDataFrame([(1, "AFFINE"), (1, "GCP"), (1, "RPC"), (1, "SICD"), (2, "RSM"), (2, "RPC"), (3, "CSCRNA")], "image_id int, kind string")
    got = {r.image_id: (r.approximate, r.precise, r.model) for r in models.choose_models(rows).collect()}
    assert got == {1: ("GCP", "SICD", "COMPOSITE"), 2: (None, "RSM", "RSM"), 3: ("CSCRNA", None, "CSCRNA")}


def test_rsm_forms(spark):
    axes = F.array(*(F.array(*(F.lit(float(i == j)) for j in range(3))) for i in range(3)))
    origin = F.struct(*(F.lit(v).alias(n) for n, v in zip("xyz", (1.0, 2.0, 3.0), strict=True)))
    lon, lat = deg(-30, 20)
    for form in "GHR":
        d = models.ground_domain(F.lit(form), lon, lat, F.lit(50.0), origin, axes)
        back = models.ground_domain_inverse(F.lit(form), *d, origin, axes)
        row = one(spark, *back)
        assert math.cos(row[0] - math.radians(-30)) == pytest.approx(1) and (math.degrees(row[1]), row[2]) == pytest.approx((20, 50), abs=1e-6)


def test_defaults(spark):
    given, base = F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("0"), F.lit("b"), F.lit("2"))
    assert one(spark, models.options(given, base), models.defaulted_elevation(F.lit(float("nan")), F.lit(3.0))) == ({"a": "1", "b": "2"}, 3.0)


@pytest.mark.parametrize("kind", ["PLANE", "PFA", "RGAZCOMP", "INCA"])
def test_sar_round_trip(spark, kind):
    """Pixels of a chip to the ground and back; the place lies on the contour, at the range and rate that numpy gives."""
    docs = spark.createDataFrame([(1, sar_images.sicd_xml(kind, (100, 50)))], "image_id int, xml string")
    params = products.sicd(docs)
    pixels = spark.createDataFrame([(1, float(c), float(r)) for r in (0, 900, 1700) for c in (10, 750, 1400)], "image_id int, c0 double, r0 double")
    ground = sar.image_to_world(pixels, params, x="c0", y="r0")
    for g in sar.world_to_image(ground, params).collect():
        assert (g.x, g.y) == pytest.approx((g.c0, g.r0), abs=0.1) and g.miss < 0.01
        rg, az = g.r0 + 100 - 1000, g.c0 + 50 - 800
        t = 0.01 + 1e-5 * az
        arp, varp, place = np.array([6878137.0, -100 + 7000 * t, 490000 + 20 * t]), np.array([0, 7000.0, 20]), np.array([g.place.x, g.place.y, g.place.z])
        scp, plane = np.array([6378137.0, 0, 0]), np.array([6378137.0, 0, 0]) + rg * np.array([-0.6, 0, 0.8]) + az * np.array([0, 1.0, 0])
        r0 = np.linalg.norm(arp - scp)
        dt, f = t - (0.005 + 1.43e-4 * az), 1 + 1e-7 * az + 2e-7 * rg
        r_inca = math.sqrt((700071.0 + rg) ** 2 + f * (varp @ varp) * dt**2)
        theta = -0.01 * t
        k, along, across = 1 + 0.002 * theta, rg * math.cos(theta) + az * math.sin(theta), az * math.cos(theta) - rg * math.sin(theta)
        r, rdot = {
            "PLANE": (np.linalg.norm(arp - plane), varp @ (arp - plane) / np.linalg.norm(arp - plane)), "RGAZCOMP": (r0 + rg, varp @ (arp - scp) / r0 - np.linalg.norm(varp) * 1.4e-6 * az),
            "INCA": (r_inca, f / r_inca * (varp @ varp) * dt), "PFA": (r0 + k * along, varp @ (arp - scp) / r0 + (0.002 * along + k * across) * -0.01),
        }[kind]
        assert np.linalg.norm(arp - place) == pytest.approx(r, abs=1e-4) and varp @ (arp - place) / np.linalg.norm(arp - place) == pytest.approx(rdot, abs=1e-6)
        assert place[0] == pytest.approx(6378137.0, abs=1e-6)


def test_sar_models_in_one_batch(spark):
    """Images of all kinds in one table, one without model, and adjustable offsets."""
    docs = spark.createDataFrame([(k, sar_images.sicd_xml(k)) for k in ("PLANE", "PFA", "RGAZCOMP", "INCA")] + [("none", "<SICD/>")], "image_id string, xml string")
    params = products.sicd(docs).where("scp.x is not null")
    rows = spark.createDataFrame([(k, 700.0 + i, 1100.0 - i) for i in range(5) for k in ("PLANE", "PFA", "RGAZCOMP", "INCA", "none")], "image_id string, x0 double, y0 double")
    ground = sar.image_to_world(rows, params, x="x0", y="y0").coalesce(1)
    back = sar.world_to_image(ground, params).collect()
    assert len(back) == 20 and all((b.x, b.y) == pytest.approx((b.x0, b.y0), abs=0.1) for b in back)
    none = S.packed(S.literal((0, 0, 0)))
    moved = sar.image_to_world(rows, params.withColumns({"range_bias": F.lit(10.0), "delta_arp": none, "delta_varp": none}), x="x0", y="y0", offsets=True)
    apart = ground.alias("a").join(moved.alias("b"), ["image_id", "x0"]).select((F.col("a.place.z") - F.col("b.place.z")).alias("d")).collect()
    assert len(apart) == 20 and all(10 < abs(r.d) < 20 for r in apart)


def test_sidd_products(spark):
    """A chip's corner and centre are where the full image has them, there and back, and chips of chips are written."""
    docs = spark.createDataFrame([(1, sar_images.sidd_xml()), (2, sar_images.sidd_xml(chip=False)), (3, "<SIDD/>"), (4, "broken")], "image_id int, xml string")
    params = products.with_chips(products.sidd(docs)).cache()
    assert sorted(r.image_id for r in params.collect()) == [1, 2]
    pixels = spark.createDataFrame([(1, 0.0, 0.0), (2, 300.0, 300.0), (1, 250.0, 350.0), (2, 800.0, 1000.0)], "image_id int, x0 double, y0 double")
    got = {(r.image_id, r.x0): r for r in sar.world_to_image(sar.image_to_world(pixels, params, x="x0", y="y0"), params).collect()}
    assert all((r.x, r.y) == pytest.approx((r.x0, r.y0), abs=0.1) for r in got.values())
    near = lambda a, b: [a.place.x, a.place.y, a.place.z] == pytest.approx([b.place.x, b.place.y, b.place.z], abs=1e-3)
    assert near(got[1, 0.0], got[2, 300.0]) and near(got[1, 250.0], got[2, 800.0])
    centre = got[2, 800.0].place
    assert (centre.x, centre.y, centre.z) == pytest.approx((6378137.0, 0, 0), abs=1e-3)
    chip = tiling.sidd_chip(F.lit(10), F.lit(20), F.lit(64), F.lit(32), F.col("chip"))
    written = docs.join(params.select("image_id", "chip"), "image_id").select("image_id", products.chipped_sidd_xml(F.col("xml"), chip).alias("xml"))
    again = {r.image_id: r.chip for r in products.sidd(written).collect()}
    assert (again[1].rows, again[1].cols) == (32, 64) and (again[2].corners[0].col, again[2].corners[0].row) == (10, 20)
    assert again[1].corners[0].col == pytest.approx(300 + 10 / 511 * 1024) and again[1].corners[2].row == pytest.approx(300 + 51 / 511 * 1024)


def test_sicd_chip_documents(spark):
    """A chip's document places its pixels where the full image's does."""
    docs = spark.createDataFrame([(1, sar_images.sicd_xml("INCA"))], "image_id int, xml string")
    cut = docs.select("image_id", products.chipped_sicd_xml(F.col("xml"), F.lit(64), F.lit(32), F.lit(200), F.lit(100)).alias("xml"))
    row = products.sicd(cut).first()
    assert (row.first_row, row.first_col, row.num_rows, row.num_cols) == (32, 64, 100, 200)
    at = lambda x, y: spark.createDataFrame([(1, x, y)], "image_id int, x double, y double")
    a, b = sar.image_to_world(at(5.0, 6.0), products.sicd(cut)).first(), sar.image_to_world(at(69.0, 38.0), products.sicd(docs)).first()
    assert a.place == b.place


def test_no_contour(spark):
    point = S.contour_on_plane(F.lit(10.0), F.lit(0.0), S.literal((6878137.0, 0, 0)), S.literal((0, 7000.0, 0)), S.literal((6378137.0, 0, 0)), S.literal((1.0, 0, 0)))
    assert one(spark, point)[0] is None


def test_terrain_contour(spark):
    """A flat terrain at 120 m is met where the contour has that height."""
    rows = spark.createDataFrame([(1,)], "id int").withColumns({"scp": S.packed(S.literal((6378137.0, 0, 0))), "arp": S.packed(S.literal((6878137.0, 0.0, 490000.0))), "varp": S.packed(S.literal((0.0, 7000.0, 0.0))), "r": F.lit(700071.0), "rdot": F.lit(10.0)})
    side = F.lit("R")
    rows = sar.on_height(rows, "r", "rdot", "arp", "varp", "scp", side, F.lit(0.0), "low")
    rows = sar.on_height(rows, "r", "rdot", "arp", "varp", "scp", side, F.lit(300.0), "high")
    along = sar.contour_points(rows, "r", "rdot", "arp", "varp", "low", "high", side)
    height = G.ecef_to_geodetic(*S.unpacked(F.col("point")))[2]
    hit = sar.first_terrain_point(along.withColumn("delta", height - 120.0), "id", side)
    got = hit.select(G.ecef_to_geodetic(*S.unpacked(F.col("point")))[2]).collect()
    assert len(got) == 1 and got[0][0] == pytest.approx(120, abs=0.1)
    assert one(spark, S.side_of_track(S.literal((6378137.0, 0, 0)), S.literal((6878137.0, 0, 490000.0)), S.literal((0, 7000.0, 0))))[0] == "R"


def test_crossings_between_ranges(spark):
    """The next step may lie in a later range, or nowhere; a step without height is no crossing."""
    rows = [(1, 0, 2.0), (1, 9000, -2.0), (1, 9001, -1.0), (1, 50000, 3.0), (2, 4095, 1.0), (2, 4096, -3.0), (3, 7, 0.0), (3, 8, None), (3, 9, -1.0), (None, 1, 1.0), (None, 2, -1.0)]
    got = sar.crossings(spark.createDataFrame(rows, "id int, step int, delta double"), "id", "delta")
    assert got.columns == ["id", "step", "delta", "fraction"]
    assert sorted(((r.id, r.step, r.fraction) for r in got.collect()), key=repr) == sorted([(1, 0, 0.5), (1, 9001, 0.25), (2, 4095, 0.25), (3, 7, 0.0), (None, 1, 0.5)], key=repr)


def test_feature_update(spark):
    props = F.lit('{"imageGeometry":{"type":"Point","coordinates":[1,2]},"bounds_imcoords":[0,0,1,1]}')
    new = one(spark, FE.updated_properties(props, F.lit("Polygon"), F.lit("[[[0,0],[4,0],[4,3],[0,0]]]")))[0]
    assert set(new) == {"imageGeometry", "bounds_imcoords"} and new["bounds_imcoords"] == "[0.0,0.0,4.0,3.0]"
    assert one(spark, FE.find_image_geometry(F.lit('{"bounds_imcoords":[0,0,1,1]}'), deprecated=False))[0] is None


def test_geolocated_geometries(spark):
    """Any nesting and any number of values a place; a third value of the grid becomes the height."""
    shapes = ["[1, 2]", "[[0,0],[10.5,-3e0,7]]", "[[[[0,0],[10,0],[10,10],[0,0]]],[[[1,1],[2,1],[2,2],[1,1]]]]", None]
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(shapes)], "image int, id int, coordinates string")
    box = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], "image int, xmin double, ymin double, xmax double, ymax double")
    grid = FE.control_grid(box, "image").withColumns({"lon": F.radians(F.col("x") / 100), "lat": F.radians(-F.col("y") / 100), "height": F.col("x") + F.col("y")})
    got = {r.id: r.world_coordinates for r in FE.geolocated_geometries(rows, grid, "image", ["lon", "lat", "height"]).collect()}
    assert got[3] is None and json.loads(got[0]) == pytest.approx([0.01, -0.02, 3.0])
    assert [len(p) for p in json.loads(got[1])] == [3, 3] and json.loads(got[1])[1] == pytest.approx([0.105, 0.03, 7.5])
    nested = json.loads(got[2])
    assert [len(ring) for part in nested for ring in part] == [4, 4] and nested[1][0][2] == pytest.approx([0.02, -0.02, 4.0])


@pytest.mark.parametrize("adjustment, want", [("NONE", {1: [44], 2: [3, 4], 3: [1, 2, 3, 4]}), ("MINMAX", {1: [0], 3: [0, 0, 0]}), ("DRA", {1: [0], 3: [0, 0, 0]})])
def test_display(spark, adjustment, want):
    """One band, two and four; values of 300 wrap around where nothing is adjusted."""
    bands = {1: [300.0], 2: [3.0, 4.0], 3: [1.0, 2.0, 3.0, 4.0]}
    rows = spark.createDataFrame([(i, b + 1, 0, 0, v) for i, vs in bands.items() for b, v in enumerate(vs)], "image int, band int, x int, y int, v double")
    got = {r.image: r.bands for r in statistics.displayed(rows, adjustment=adjustment).collect()}
    assert {i: got[i] for i in want} == want
    if adjustment != "NONE":  # sqrt of 5, the power 25, times 51 over three times the mean magnitude 5
        assert got[2] == [int(255 * 5 / 15)]


def test_rpc_seed(spark):
    """The search starts at the seed; rows without model get nulls, or the approximate place."""
    rows = geodesy.with_rpc(spark.createDataFrame([(1, 20.0, 10.0, 100.0), (2, -120.0, -40.0, 3000.0)], "id int, lon double, lat double, height double"))
    samp, line = models.rpc_forward(F.col("lon"), F.col("lat"), F.col("height"))
    rows = rows.withColumns({"x": samp, "y": line}).withColumn("samp_den", F.when(F.col("id") == 1, F.col("samp_den")))
    got = {r.id: r for r in models.rpc_inverse(rows, seed=("lon", "lat")).collect()}
    assert (got[1].lon_deg, got[1].lat_deg) == pytest.approx((20, 10), abs=1e-9) and got[1].residual < 1e-6 and got[2].lon_deg is None
    both = {r.id: (r.lon_deg, r.lat_deg) for r in models.rpc_composite(rows, (F.col("lon") + 1, F.col("lat") - 1)).collect()}
    assert both[1] == pytest.approx((20, 10), abs=1e-9) and both[2] == (-119.0, -41.0)


@pytest.mark.parametrize("gt, at", [((0.0, 2.0, 0.0, 4.0, 0.0, -2.0), (1.0, 3.0)), ((0.0, 2.0, 0.0, 0.0, 0.0, 2.0), (1.0, 1.0)), ((4.0, -2.0, 0.0, 4.0, 0.0, -2.0), (3.0, 3.0)), ((4.0, -2.0, 0.0, 0.0, 0.0, 2.0), (3.0, 1.0))])
def test_offset_orientations(spark, gt, at):
    """The first post is the centre of the first pixel, whichever way the axes run; a rotated grid is an error."""
    tiles = lambda gt: spark.createDataFrame([("t", 2, 2, list(gt), [0.0, 1.0, 2.0, 3.0], -1.0)], "tile_id string, width int, height int, gt array<double>, z array<double>, no_data double")
    places = spark.createDataFrame([("t", *at), ("t", 2.0, 2.0)], "tile_id string, lon_deg double, lat_deg double")
    grid = E.offset_tiles(tiles(gt), 10.0)
    assert sorted(r.sampled for r in E.sample(places, E.cut_blocks(grid), grid).collect()) == [0.0, 15.0]
    with pytest.raises(Exception, match="rotated"):
        E.offset_tiles(tiles((0.0, 2.0, 0.1, 0.0, 0.0, 2.0))).select("gt").collect()


def test_chips_and_corners(spark):
    h = [F.lit(v) for v in (10.0, 2.0, 0.0, 20.0, 0.0, 2.0, 0.0, 0.0)]
    assert one(spark, *models.to_chip(h, F.lit(3.0), F.lit(4.0))) == (16.0, 28.0)
    assert one(spark, G.geolocation_corners([deg(-121.5, -10.5)] * 4))[0] == "103000S1213000W" * 4
    row = one(spark, E.constant_summary(12.0))[0]
    assert (row.min_z, row.max_z, row.post_spacing) == (12.0, 12.0, 30.0)
    parts = spark.createDataFrame([(1, [[[(0.0, 0.0)]], [[(1.0, 1.0)]]])], "geom_id int, parts array<array<array<struct<x:double,y:double>>>>")
    assert [(r.part, r.rings[0][0].x) for r in spatial.explode_parts(parts).orderBy("part").collect()] == [(0, 0.0), (1, 1.0)]


def test_png(spark):
    rows = spark.createDataFrame([(7, x, y, [x + y + 1]) for x in range(4) for y in range(4)], "tile int, x int, y int, bands array<int>")
    row = tiling.encode_png(rows, ["tile"], 4).first()
    assert row.tile == 7 and bytes(row.payload[:8]) == b"\x89PNG\r\n\x1a\n"


def test_tiles_for_area(spark):
    area = spark.createDataFrame([(1, 0.1, 0.1), (1, 0.2, 0.2)], "area int, lon double, lat double")
    assert tiling.tiles_for_area(area, "area", 6).count() > 1
    assert one(spark, tiling.overview_level(F.lit(2048.0), 256, F.lit(2)), tiling.overview_level(F.lit(100.0), 256, F.lit(2))) == (2, 0)
