"""Shapefiles made by hand, their pruning, and polygons stored by cell."""

import glob
import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from orbitframe.operators import geometries as N
from orbitframe.sources import vectors as V


def record(kind, parts):
    """Content of a record; parts are lists of places."""
    if kind == 0:
        return struct.pack("<i", 0)
    places = [p for part in parts for p in part]
    flat = [v for p in places for v in p]
    if kind % 10 == 1:
        return struct.pack("<i2d", kind, *flat) + struct.pack("<d", 5.0) * (kind // 10)
    box = (min(p[0] for p in places), min(p[1] for p in places), max(p[0] for p in places), max(p[1] for p in places))
    if kind == 8:
        return struct.pack("<i4di", kind, *box, len(places)) + struct.pack(f"<{len(flat)}d", *flat)
    starts = [sum(len(q) for q in parts[:i]) for i in range(len(parts))]
    extra = struct.pack(f"<{len(places) + 2}d", *[0.0] * (len(places) + 2)) if kind > 10 else b""
    return struct.pack("<i4d2i", kind, *box, len(parts), len(places)) + struct.pack(f"<{len(starts)}i", *starts) + struct.pack(f"<{len(flat)}d", *flat) + extra


def put(folder, name, kind, shapes, rows=None, box=(-180.0, -90.0, 180.0, 90.0)):
    contents = [record(*s) for s in shapes]
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, n // 2) + struct.pack("<2i4d", 1000, kind, *box) + b"\0" * 32
    body, index = b"", b""
    for i, c in enumerate(contents):
        index += struct.pack(">2i", (100 + len(body)) // 2, len(c) // 2)
        body += struct.pack(">2i", i + 1, len(c) // 2) + c
    path = os.path.join(folder, name)
    for ending, data in ((".shp", head(100 + len(body)) + body), (".shx", head(100 + len(index)) + index)):
        with open(path + ending, "wb") as f:
            f.write(data)
    if rows is not None:
        fields = [("NAME", b"C", 12), ("POP", b"N", 8), ("SHARE", b"F", 8), ("OPEN", b"L", 1), ("DAY", b"D", 8)]
        text = "".join(" " + "".join(str(v).ljust(w) for v, (_, _, w) in zip(r, fields, strict=True)) for r in rows)
        data = b"\x03" + b"\0" * 3 + struct.pack("<IHH", len(rows), 33 + 32 * len(fields), 38) + b"\0" * 20
        data += b"".join(n.encode().ljust(11, b"\0") + k + b"\0" * 4 + bytes([w, 0]) + b"\0" * 14 for n, k, w in fields) + b"\r" + text.encode("latin-1")
        with open(path + ".dbf", "wb") as f:
            f.write(data)
        with open(path + ".cpg", "w") as f:
            f.write("ISO-8859-1")
    return path + ".shp"


SQUARE = [(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)]  # clockwise
HOLE = [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]
ISLAND = [(20, 0), (20, 5), (25, 5), (25, 0), (20, 0)]


def floats(places):
    return [[float(x), float(y)] for x, y in places]


def test_shapes_of_all_kinds_with_attributes(spark, tmp_path):
    rows = [("Zürich", 12, 0.5, "T", "20240229"), ("", "", "", "?", ""), ("b", "********", "1e3", "N", "20240301")]
    put(tmp_path, "areas", 5, [(5, [SQUARE, ISLAND, HOLE]), (0, None), (15, [SQUARE]), (5, [HOLE])], rows)
    got = {r.record: r for r in V.read_shapefiles(spark, str(tmp_path)).collect()}
    assert json.loads(got[0].geometry) == {"type": "MultiPolygon", "coordinates": [[floats(SQUARE), floats(HOLE)], [floats(ISLAND)]]}
    assert (got[0].xmin, got[0].ymin, got[0].xmax, got[0].ymax) == (0, 0, 25, 9)
    assert got[1].geometry is None and got[1].xmin is None and json.loads(got[2].geometry) == {"type": "Polygon", "coordinates": [floats(SQUARE)]}
    assert json.loads(got[3].geometry)["coordinates"] == [floats(HOLE)] and got[3].properties is None  # a lone ring of the wrong order; no attributes
    assert json.loads(got[0].properties) == {"NAME": "Zürich", "POP": 12, "SHARE": 0.5, "OPEN": True, "DAY": "2024-02-29"}
    assert json.loads(got[1].properties) == dict.fromkeys(("NAME", "POP", "SHARE", "OPEN", "DAY")) and json.loads(got[2].properties)["POP"] is None
    os.mkdir(tmp_path / "more")
    put(tmp_path / "more", "lines", 3, [(3, [[(0, 0), (1, 1)]]), (23, [[(0, 0), (1, 1)], [(5, 5), (6, 7)]])])
    put(tmp_path / "more", "points", 1, [(1, [[(3, 4)]]), (11, [[(5, 6)]]), (8, [[(1, 2), (3, 4)]])])
    put(tmp_path / "more", "none", 1, [])
    kinds = sorted(json.loads(r.geometry)["type"] for r in V.read_shapefiles(spark, str(tmp_path / "more")).collect())
    assert kinds == ["LineString", "MultiLineString", "MultiPoint", "Point", "Point"]
    read = V.read_shapefiles(spark, str(tmp_path)).select("record", N.parts_of(F.col("geometry")).alias("parts"))
    assert read.where("size(parts) > 0").count() == 8


def test_rectangles_prune_files_ranges_and_records(spark, tmp_path):
    far = [(1, [[(100 + i, 50)]]) for i in range(10)]
    put(tmp_path, "near", 1, [(1, [[(i, i)]]) for i in range(25)], box=(0.0, 0.0, 24.0, 24.0))
    put(tmp_path, "far", 1, far, box=(100.0, 50.0, 109.0, 50.0))
    every = V.read_shapefiles(spark, str(tmp_path), partitionRecords=10)
    assert every.rdd.getNumPartitions() == 4 and every.count() == 35
    some = V.within(every, 3.5, 0, 7, 99)
    assert some.rdd.getNumPartitions() == 3 and sorted(r.xmin for r in some.collect()) == [4, 5, 6, 7]
    assert V.within(every, 30, 30, 60, 60).collect() == [] and every.where("xmin = 5.0").count() == 1 and every.where("xmin in (100.0, 3.0, 77.0)").count() == 2
    assert every.where("xmin > 23 and geometry like '%Point%'").count() == 11


def test_damaged_shapefiles(spark, tmp_path):
    good = put(tmp_path, "a", 1, [(1, [[(i, i)]]) for i in range(4)])
    data = bytearray(open(good, "rb").read())
    data[100 + 28 + 8 : 100 + 28 + 12] = struct.pack("<i", 31)  # a patch
    open(good, "wb").write(bytes(data))
    open(put(tmp_path, "b", 1, [(1, [[(9, 9)]])]), "wb").write(b"no shapes" * 30)
    os.remove(put(tmp_path, "c", 1, [(1, [[(9, 9)]])])[:-1] + "x")
    got = V.read_shapefiles(spark, str(tmp_path), corrupt="skip").collect()
    assert sorted(r.xmin for r in got) == [0, 2, 3]
    for name in "abc":
        with pytest.raises(Exception, match="ValueError"):
            V.read_shapefiles(spark, str(tmp_path / f"{name}.shp")).collect()


def test_only_touched_parts_of_stored_polygons_are_read(spark, tmp_path):
    square = lambda x, y, w: json.dumps({"type": "Polygon", "coordinates": [[[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]]})
    rows = [(1, square(1, 1, 3)), (2, square(2, 2, 3)), (3, square(200, 200, 3)), (4, square(-500, -500, 1200)), (5, None)]
    path = str(tmp_path / "stored")
    V.store_polygons(spark.createDataFrame(rows, "id int, geometry string"), path, "id")
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([(2.5, 2.5), (1.5, 1.5), (4.5, 4.5), (9, 9), (-600, 0)])] + [(9, None, 1.0)], "p int, x double, y double")
    want = {(0, 1), (0, 2), (1, 1), (2, 2), (0, 4), (1, 4), (2, 4), (3, 4)}
    found = V.stored_holders(points, path, "x", "y")
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()
    assert {(r.p, r.key) for r in found.collect()} == want
    assert {(r.p, r.key) for r in V.stored_holders(points, path, "x", "y", limit=0).collect()} == want  # too many parts to broadcast
    damaged = 0
    for f in glob.glob(f"{path}/cells/level=*/part_x=12/part_y=*/*.parquet") + glob.glob(f"{path}/cells/level=*/part_x=13/part_y=*/*.parquet"):
        if "level=0" in f:
            open(f, "wb").write(b"unreadable" * 100)
            damaged += 1
    assert damaged
    for f in glob.glob(f"{path}/**/.*.crc", recursive=True):
        os.remove(f)
    assert {(r.p, r.key) for r in V.stored_holders(points, path, "x", "y").collect()} == want
    with pytest.raises(Exception):  # noqa: B017
        V.stored_holders(points, path, "x", "y", limit=0).collect()
    assert V.stored_holders(points.limit(0), path, "x", "y").collect() == []


def test_a_store_without_polygons(spark, tmp_path):
    path = str(tmp_path / "stored")
    V.store_polygons(spark.createDataFrame([("a", '{"type":"Point","coordinates":[1,2]}'), ("b", None)], "id string, geometry string"), path, "id")
    assert V.stored_holders(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), path, "x", "y").collect() == []
