"""Spatial joins by cells: an equality join on grid cells, then the exact test.

A pair that shares several cells is kept only in the cell of its lowest common corner, so nothing has to be made
distinct afterwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.lineage import cut
from orbitframe.operators import geometries as N

BOX = ("xmin", "ymin", "xmax", "ymax")


def cells(df: DataFrame, size: float, grow: float = 0.0, prefix: str = "") -> DataFrame:
    """One row per cell (cell_x, cell_y) that a box, grown on all sides, touches."""
    c = lambda n: F.col(prefix + n)
    span = lambda lo, hi: F.explode(F.sequence(F.floor((lo - grow) / size), F.floor((hi + grow) / size)))
    return df.withColumn("cell_x", span(c("xmin"), c("xmax"))).withColumn("cell_y", span(c("ymin"), c("ymax")))


def overlap(a: str, b: str) -> Column:
    """Whether two boxes meet, a common edge included."""
    c = F.col
    return (c(f"{a}xmin") <= c(f"{b}xmax")) & (c(f"{b}xmin") <= c(f"{a}xmax")) & (c(f"{a}ymin") <= c(f"{b}ymax")) & (c(f"{b}ymin") <= c(f"{a}ymax"))


def box_distance(a: str, b: str) -> Column:
    c = F.col
    gap = lambda lo, hi: F.greatest(F.lit(0.0), c(f"{a}{lo}") - c(f"{b}{hi}"), c(f"{b}{lo}") - c(f"{a}{hi}"))
    dx, dy = gap("xmin", "xmax"), gap("ymin", "ymax")
    return F.sqrt(dx * dx + dy * dy)


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def find_intersects(features: DataFrame, queries: DataFrame, size: float) -> DataFrame:
    """Pairs of boxes that meet, with f_ and q_ columns."""
    left = cells(_prefixed(queries, "q_"), size, prefix="q_")
    right = cells(_prefixed(features, "f_"), size, prefix="f_")
    low = lambda axis: F.floor(F.greatest(F.col(f"q_{axis}min"), F.col(f"f_{axis}min")) / size)
    once = (F.col("cell_x") == low("x")) & (F.col("cell_y") == low("y"))
    return left.join(right, ["cell_x", "cell_y"]).where(overlap("q_", "f_") & once).drop("cell_x", "cell_y")


def find_nearest(features: DataFrame, queries: DataFrame, query_key: str, max_distance: float) -> DataFrame:
    """For each query all nearest features within a distance; ties are all kept.

    Boxes of the same place are compared once, and their rows put together at the end, so that copies multiply the
    result alone.
    """
    f_box, q_box = [f"f_{n}" for n in BOX], [f"q_{n}" for n in BOX]
    f_all, q_all = _prefixed(features, "f_"), _prefixed(queries, "q_")
    left = cells(q_all.select(*q_box).distinct(), max_distance, max_distance, "q_")
    right = cells(f_all.select(*f_box).distinct(), max_distance, prefix="f_")
    low = lambda axis: F.floor(F.greatest(F.col(f"q_{axis}min") - max_distance, F.col(f"f_{axis}min")) / max_distance)
    once = (F.col("cell_x") == low("x")) & (F.col("cell_y") == low("y"))
    pairs = left.join(right, ["cell_x", "cell_y"]).where(once).select(*q_box, F.struct(*f_box).alias("_f"), box_distance("q_", "f_").alias("distance")).where(F.col("distance") <= max_distance)
    best = pairs.groupBy(*q_box).agg(F.min("distance").alias("distance"))  # partial sums instead of a window over a hot query
    tied = pairs.join(best, [*q_box, "distance"]).select(*q_box, "distance", "_f.*")
    return q_all.join(tied, q_box).join(f_all, f_box).select(*q_all.columns, *f_all.columns, "distance")


def polygon_covering(polygons: DataFrame, size: float = 1.0) -> DataFrame:
    """Cells of several sizes of polygons with rings, with columns g_level, g_cell_x, g_cell_y, g_inside, g_edges, g_origin and g_key.

    Rings are relative to the struct origin (x, y), if there is one.  Of polygons of the same shape and place the one with
    the smallest id is taken, so copies cost nothing.
    """
    if "origin" not in polygons.columns:
        polygons = polygons.withColumn("origin", F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    shapes = polygons.groupBy("origin", "rings").agg(F.min("geom_id").alias("geom_id"))
    parts = shapes.select("geom_id", "origin", F.array(F.struct(F.lit(2).alias("dim"), "rings")).alias("parts"))
    return _prefixed(N.covering(parts, "geom_id", size=size, origin="origin"), "g_")


def _meets_cell(x: str, y: str) -> Column:
    return (F.col("p_cell_x") == F.col("g_cell_x")) & (F.col("p_cell_y") == F.col("g_cell_y")) & N.held(F.col(x) - F.col("g_origin.x"), F.col(y) - F.col("g_origin.y"), "g_edges", "g_inside")


def _first_of_cells(cells: DataFrame) -> DataFrame:
    """The rows of a covering that may hold a cell's places with the smallest id: none after the first polygon that holds the cell whole."""
    at = ["g_level", "g_cell_x", "g_cell_y"]
    whole = cells.where(F.size("g_edges") == 0).groupBy(*at).agg(F.min("g_key").alias("_whole"))
    return cells.join(whole, at, "left").where(F.col("_whole").isNull() | (F.col("g_key") <= F.col("_whole"))).drop("_whole")


def find_polygon(points: DataFrame, polygons: DataFrame, x: str, y: str, key: str, size: float = 1.0) -> DataFrame:
    """Points with the smallest id of a polygon that holds them, or null."""
    cells, found = _first_of_cells(cut(polygon_covering(polygons, size))), []
    for level in N.levels(cells.select(F.col("g_level").alias("level"))):
        placed, here = N.at_level(points.select(key, x, y), x, y, level, "p_"), cells.where(F.col("g_level") == level)
        found.append(placed.join(here, _meets_cell(x, y)).select(F.col(key), F.col("g_key").alias("geom_id")))
    if not found:
        return points.withColumn("geom_id", F.lit(None).cast(polygons.schema["geom_id"].dataType))
    return points.join(reduce(DataFrame.unionByName, found).groupBy(key).agg(F.min("geom_id").alias("geom_id")), key, "left")


def covered(points: DataFrame, polygons: DataFrame, x: str, y: str, size: float = 1.0, invert: bool = False) -> DataFrame:
    """The points inside some polygon, or those inside none."""
    found, rest, names = [], points, points.columns
    cells = _first_of_cells(cut(polygon_covering(polygons, size)))
    for level in N.levels(cells.select(F.col("g_level").alias("level"))):
        placed, here = N.at_level(rest, x, y, level, "p_"), cells.where(F.col("g_level") == level)
        found.append(placed.join(here, _meets_cell(x, y), "left_semi").select(*names))
        rest = placed.join(here, _meets_cell(x, y), "left_anti").select(*names)
    return rest if invert else reduce(DataFrame.unionByName, found) if found else points.limit(0)


def explode_parts(features: DataFrame, parts: str = "parts", key: str = "geom_id") -> DataFrame:
    """Multi-part geometries as one row per part, numbered in order."""
    return features.select("*", F.posexplode(parts).alias("part", "rings")).drop(parts).withColumn("part", F.col("part").cast("int"))


def polygon_parts(geometry: Column) -> Column:
    """Polygons of a GeoJSON geometry (JSON text), each an array of rings of structs x, y; collections may be nested to any depth.

    Geometries without area give nothing, as does null.
    """
    return F.transform(F.filter(N.parts_of(geometry), lambda p: p["dim"] == 2), lambda p: p["rings"])


def cell_geometries(features: DataFrame, geometry: str = "geometry", key: str = "id", size: float = 1.0, tol: float = 0.0) -> DataFrame:
    """cell_x, cell_y, key, part and rings of features' polygons, cut to each cell that they touch, which is grown by tol.

    Written with partitionBy("cell_x", "cell_y"), a place reads its cell alone.
    """
    parts = explode_parts(features.select(F.col(key), polygon_parts(F.col(geometry)).alias("parts")), key=key)
    points = F.flatten("rings")
    axis = lambda n: F.transform(points, lambda p: p[n])
    boxed = parts.withColumns({f"{n}{w}": f(axis(n)) for n in "xy" for w, f in (("min", F.array_min), ("max", F.array_max))})
    placed = cells(boxed, size, tol).drop(*BOX)
    x0, y0 = F.col("cell_x") * size - tol, F.col("cell_y") * size - tol
    cut = F.filter(F.transform("rings", lambda r: clip_box(r, x0, y0, x0 + size + 2 * tol, y0 + size + 2 * tol)), lambda r: F.size(r) > 0)
    return placed.select("cell_x", "cell_y", key, "part", cut.alias("rings")).where(F.size("rings") > 0)


def clip_box(ring: Column, xmin: float | Column, ymin: float | Column, xmax: float | Column, ymax: float | Column) -> Column:
    """Ring of structs x, y cut to a box, one side after the other; the result is closed, or empty."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

    def side(points: Column, axis: str, limit: float | Column, above: bool) -> Column:
        other = "y" if axis == "x" else "x"
        inside = lambda p: p[axis] >= limit if above else p[axis] <= limit

        def cut(a: Column, b: Column) -> Column:
            f = F.try_divide(limit - a[axis], b[axis] - a[axis])
            o = a[other] + f * (b[other] - a[other])
            return point(limit, o) if axis == "x" else point(o, limit)

        nexts = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, F.least(F.size(points), F.lit(1))))
        steps = F.zip_with(points, nexts, lambda a, b: F.when(inside(a) & inside(b), F.array(b)).when(inside(a), F.array(cut(a, b))).when(inside(b), F.array(cut(a, b), b)).otherwise(F.slice(F.array(b), 1, 0)))
        return F.flatten(steps)

    open_ring = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))
    xmin, ymin, xmax, ymax = (v if isinstance(v, Column) else F.lit(float(v)) for v in (xmin, ymin, xmax, ymax))
    for axis, limit, above in (("x", xmin, True), ("x", xmax, False), ("y", ymin, True), ("y", ymax, False)):
        open_ring = side(open_ring, axis, limit, above)
    return F.when(F.size(open_ring) > 0, F.concat(open_ring, F.slice(open_ring, 1, 1))).otherwise(open_ring)
