"""Geometry predicates against plain versions on all pairs."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from orbitframe.operators import geometries as N


def leaves(g):
    if g is None:
        return []
    c = g.get("coordinates")
    return {
        "Point": lambda: [(0, [[c]])], "MultiPoint": lambda: [(0, [[p]]) for p in c], "LineString": lambda: [(1, [c])], "MultiLineString": lambda: [(1, [r]) for r in c],
        "Polygon": lambda: [(2, c)], "MultiPolygon": lambda: [(2, p) for p in c], "GeometryCollection": lambda: [x for m in g["geometries"] for x in leaves(m)],
    }[g["type"]]()


def edges(part):
    dim, rings = part
    out = []
    for r in rings:
        r = [tuple(p[:2]) for p in r]
        if dim == 2 and r[0] != r[-1]:
            r = [*r, r[0]]
        out += [(r[0], r[0])] if len(r) == 1 else list(zip(r, r[1:]))
    return out


def turn(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def on(a, b, p):
    return turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def meet(s, t):
    (a, b), (c, d) = s, t
    if any((on(a, b, c), on(a, b, d), on(c, d, a), on(c, d, b))):
        return True
    sign = lambda v: (v > 0) - (v < 0)
    return sign(turn(a, b, c)) * sign(turn(a, b, d)) < 0 and sign(turn(c, d, a)) * sign(turn(c, d, b)) < 0


def inside(part, p):
    if part[0] != 2:
        return False
    n = sum(((a[1] > p[1]) != (b[1] > p[1])) and p[0] < a[0] + (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) for a, b in edges(part))
    return n % 2 == 1


def apart(p, s):
    (ax, ay), (bx, by) = s
    dx, dy = bx - ax, by - ay
    t = max(0, min(1, ((p[0] - ax) * dx + (p[1] - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
    return math.hypot(p[0] - ax - t * dx, p[1] - ay - t * dy)


def distance(g, h):
    best = math.inf
    for a in leaves(g):
        for b in leaves(h):
            if inside(a, edges(b)[0][0]) or inside(b, edges(a)[0][0]):
                return 0.0
            for s in edges(a):
                for t in edges(b):
                    best = min(best, 0.0 if meet(s, t) else min(apart(t[0], s), apart(t[1], s), apart(s[0], t), apart(s[1], t)))
    return best


def some(rng, extent=60):
    p = lambda: [rng.randint(0, extent), rng.randint(0, extent)]
    x, y = p()
    w, h = rng.randint(1, 12), rng.randint(1, 12)
    box = [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]
    hole = [[x + 3, y + 3], [x + w - 1, y + 3], [x + w - 1, y + h - 1], [x + 3, y + h - 1], [x + 3, y + 3]]
    return rng.choice([
        {"type": "Point", "coordinates": p()}, {"type": "LineString", "coordinates": [[x, y], [x + w, y + h], [x + w, y]]}, {"type": "Polygon", "coordinates": [box]},
        {"type": "Polygon", "coordinates": [box, hole] if w > 5 and h > 5 else [box]}, {"type": "MultiPoint", "coordinates": [p(), p()]}, {"type": "MultiPolygon", "coordinates": [[box], [[[x + 20, y], [x + 25, y], [x + 22, y + 4]]]]},
        {"type": "GeometryCollection", "geometries": [{"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": p()}, {"type": "MultiLineString", "coordinates": [[p(), p()]]}]}]},
    ])


def tables(spark, seed, n, m):
    rng = random.Random(seed)
    f, q = [some(rng) for _ in range(n)], [some(rng) for _ in range(m)]
    q += [{"type": "Polygon", "coordinates": [[[-1e6, -1e6], [1e6, -1e6], [1e6, 1e6], [-1e6, 1e6], [-1e6, -1e6]]]}, {"type": "Point", "coordinates": [500.0, 500.0, 3.0]}, {"type": "GeometryCollection", "geometries": []}, None]
    frame = lambda rows, k: spark.createDataFrame([(i, None if g is None else json.dumps(g), "x") for i, g in enumerate(rows)], f"{k} long, geometry string, key string")
    return f, q, frame(f, "f"), frame(q, "q")


@pytest.mark.parametrize("size", [1.0, 16.0])
def test_intersecting(spark, size):
    f, q, left, right = tables(spark, 5, 60, 25)
    got = sorted(map(tuple, N.intersecting(left, right, "f", "q", size=size).collect()))
    assert got == sorted((i, j) for i, g in enumerate(f) for j, h in enumerate(q) if distance(g, h) == 0)


def test_nearest_keeps_ties(spark):
    f, q, left, right = tables(spark, 8, 40, 20)
    want = []
    for j, h in enumerate(q):
        near = [(distance(g, h), i) for i, g in enumerate(f)]
        least = min((d for d, _ in near if d <= 9.5), default=None)
        want += [(i, j, round(d, 9)) for d, i in near if d == least]
    got = sorted((r.f, r.q, round(r.distance, 9)) for r in N.nearest(left, right, "f", "q", 9.5).collect())
    assert got == sorted(want) and len({j for _, j, _ in want}) < len(want)


def test_rows_of_a_shape_are_bounded(spark):
    wide = {"type": "Polygon", "coordinates": [[[-1e7, -1e7], [1e7, -1e7], [1e7, 1e7], [-1e7, 1e7]]]}
    tiny = {"type": "Polygon", "coordinates": [[[0.1, 0.1], [0.2, 0.1], [0.2, 0.3]]]}
    rows = spark.createDataFrame([(i, json.dumps(g)) for i, g in enumerate((wide, tiny))], "id long, geometry string").select("id", N.parts_of(F.col("geometry")).alias("parts"))
    cells = N.covering(rows, "id")
    counts = {r.key: (r.n, r.inner) for r in cells.groupBy("key").agg(F.count("*").alias("n"), F.sum((F.size("edges") == 0).cast("int")).alias("inner")).collect()}
    assert all(n <= (N.SPAN + 2) ** 2 for n, _ in counts.values()) and counts[0][1] > 10  # most of the box asks for no ring test
    assert N.edge_cells(N.edges_of(rows, "id"), 1.0, [30]).groupBy("key", "ax", "ay", "bx", "by", "level").count().agg(F.max("count")).first()[0] <= 4


def test_places_on_cells_borders(spark):
    """A comb whose vertices and edges lie on the borders of cells."""
    comb = [[x, y] for k in range(8) for x, y in ((2 * k, 0), (2 * k, 8), (2 * k + 1, 8), (2 * k + 1, 0))]
    part = (2, [comb])
    rows = spark.createDataFrame([(0, json.dumps({"type": "Polygon", "coordinates": [comb]}))], "id long, geometry string").select("id", N.parts_of(F.col("geometry")).alias("parts"))
    cells = N.covering(rows, "id", size=0.5)
    places = spark.range(35 * 19).select((F.col("id") % 35 / 2 - 0.75).alias("x"), (F.floor(F.col("id") / 35) / 2 - 0.5).alias("y"))
    got = {(r.x, r.y) for r in N.holders(places, cells, "x", "y", N.levels(cells)).collect()}
    assert got == {(r.x, r.y) for r in places.collect() if inside(part, (r.x, r.y))}


def test_nothing(spark):
    none = spark.createDataFrame([], "f long, geometry string")
    some_ = spark.createDataFrame([(1, '{"type":"Point","coordinates":[1,2]}'), (2, "no geometry"), (3, "")], "q long, geometry string")
    assert N.intersecting(none, some_, "f", "q").collect() == [] and N.nearest(none, some_, "f", "q", 5.0).collect() == []


def test_places_on_edges_of_shapes_with_an_origin(spark):
    """Against the same test of the place less the origin, for places on the edges, wherever the shape lies; copies count once."""
    from orbitframe.operators import spatial
    from orbitframe.plans.imagery import DIAMOND, HOLE

    places = [((k * 7919 % 360000) / 1e3 - 180, (k * 104729 % 160000) / 1e3 - 80) for k in range(3000)]
    centres = [(-107.0, 33.0), (61.0, -42.0), (-3.0, 7.0)]
    sides = [(a, b) for ring in (DIAMOND, HOLE) for a, b in zip(ring, ring[1:], strict=False)]
    for x, y in centres:
        places += [(round(x + a[0] + (b[0] - a[0]) * t / 50, 3), round(y + a[1] + (b[1] - a[1]) * t / 50, 3)) for a, b in sides for t in range(51)]

    def inside(x, y):
        return sum((a[1] > y) != (b[1] > y) and x < a[0] + (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) for a, b in sides) % 2 == 1

    rings = [[{"x": a, "y": b} for a, b in ring] for ring in (DIAMOND, HOLE)]
    shapes = [(10 * copy + i, {"x": x, "y": y}, rings) for copy in range(3) for i, (x, y) in enumerate(centres)]
    polygons = spark.createDataFrame(shapes, "geom_id long, origin struct<x:double,y:double>, rings array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id long, x double, y double")
    want = {i: next((k for k, (cx, cy) in enumerate(centres) if inside(px - cx, py - cy)), None) for i, (px, py) in enumerate(places)}
    assert {r.id: r.geom_id for r in spatial.find_polygon(points, polygons, "x", "y", "id").collect()} == want
    held = {i for i, k in want.items() if k is not None}
    assert {r.id for r in spatial.covered(points, polygons, "x", "y").collect()} == held
    assert {r.id for r in spatial.covered(points, polygons, "x", "y", invert=True).collect()} == set(want) - held
    assert spatial.polygon_covering(polygons).select("g_key").distinct().count() == 3


def test_nearest_boxes_compare_copies_once(spark):
    from orbitframe.operators import spatial

    boxes = spark.createDataFrame([(i, float(i % 2 * 20), 0.0, float(i % 2 * 20 + 1), 1.0) for i in range(40)], "id int, xmin double, ymin double, xmax double, ymax double")
    probes = spark.createDataFrame([(i, 3.0, 0.0, 4.0, 1.0) for i in range(5)], "q int, xmin double, ymin double, xmax double, ymax double")
    got = spatial.find_nearest(boxes, probes, "q", 30.0)
    assert sorted((r.q_q, r.f_id, r.distance) for r in got.collect()) == [(q, f, 2.0) for q in range(5) for f in range(0, 40, 2)]


def test_geometries_of_one_shape_are_compared_once(spark):
    line = '{"type":"LineString","coordinates":[[0,0],[4,4]]}'
    nested = '{"type":"GeometryCollection","geometries":[%s]}' % line
    left = spark.createDataFrame([(i, nested if i % 2 else line) for i in range(30)] + [(99, None)], "f int, geometry string")
    right = spark.createDataFrame([(i, '{"type":"Point","coordinates":[2,2]}') for i in range(7)] + [(8, '{"type":"Point","coordinates":[5,4]}')], "q int, geometry string")
    shapes, rows = N._shapes(left, "f", "geometry")
    assert shapes.count() == 1 and rows.count() == 30
    assert sorted(map(tuple, N.intersecting(left, right, "f", "q").collect())) == [(f, q) for f in range(30) for q in range(7)]
    assert sorted(map(tuple, N.nearest(left, right, "f", "q", 2.0).collect())) == sorted((f, q, float(q == 8)) for f in range(30) for q in [*range(7), 8])
