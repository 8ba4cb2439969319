"""Image geometries of features, and their geolocation by a grid.

Properties are JSON text.  A geometry is a struct type, coordinates (JSON text), with its box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = "array<double>"
#: Fixed order of the properties that may hold an image geometry; the last three are deprecated.
CURRENT, DEPRECATED = ["imageGeometry", "imageBBox"], ["geom_imcoords", "detection", "bounds_imcoords"]
GRID, MARGIN = 11, 10.0


def _get(props: Column, path: str) -> Column:
    return F.get_json_object(props, f"$.{path}")


def box_ring(box: Column) -> Column:
    """Closed ring of a box [x0, y0, x1, y1], from the lower right corner against the clock."""
    x0, y0, x1, y1 = (box[i] for i in range(4))
    return F.array(F.array(x1, y0), F.array(x1, y1), F.array(x0, y1), F.array(x0, y0), F.array(x1, y0))


def find_image_geometry(props: Column, deprecated: bool = True) -> Column:
    """Struct source, type, coordinates of the first property that is there, else null."""

    def made(source: str, kind: Column, coordinates: Column) -> Column:
        return F.struct(F.lit(source).alias("source"), kind.alias("type"), coordinates.alias("coordinates"))

    polygon = F.lit("Polygon")
    boxed = lambda name: F.to_json(F.array(box_ring(F.from_json(_get(props, name), BOX))))
    tries = [
        F.when(_get(props, "imageGeometry").isNotNull(), made("imageGeometry", _get(props, "imageGeometry.type"), _get(props, "imageGeometry.coordinates"))),
        F.when(_get(props, "imageBBox").isNotNull(), made("imageBBox", polygon, boxed("imageBBox"))),
    ]
    if deprecated:
        tries += [
            F.when(_get(props, "geom_imcoords").isNotNull(), made("geom_imcoords", polygon, F.concat(F.lit("["), _get(props, "geom_imcoords"), F.lit("]")))),
            F.when(_get(props, "detection.pixelCoordinates").isNotNull(), made("detection", _get(props, "detection.type"), _get(props, "detection.pixelCoordinates"))),
            F.when(_get(props, "bounds_imcoords").isNotNull(), made("bounds_imcoords", polygon, boxed("bounds_imcoords"))),
        ]
    return F.coalesce(*tries)


def vertices(geometry: Column) -> Column:
    """All coordinate pairs of a geometry of any type, in order, as array<array<double>>."""
    number = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
    pairs = F.regexp_extract_all(geometry["coordinates"], F.lit(rf"\[\s*({number}\s*,\s*{number})"), 1)
    return F.transform(pairs, lambda p: F.transform(F.split(p, ","), lambda v: F.trim(v).cast("double")))


def bounds(points: Column) -> Column:
    axis = lambda i: F.transform(points, lambda p: p[i])
    return F.when(F.size(points) > 0, F.array(F.array_min(axis(0)), F.array_min(axis(1)), F.array_max(axis(0)), F.array_max(axis(1))))


def updated_properties(props: Column, kind: Column, coordinates: Column, deprecated: bool = True) -> Column:
    """Map of the properties that hold an image geometry, and only these, rewritten for a new one."""
    pts = vertices(F.struct(coordinates.alias("coordinates")))
    box = F.to_json(bounds(pts))
    new = {"imageGeometry": F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}")), "imageBBox": box}
    if deprecated:
        shell = F.when(kind == "Polygon", _get(F.concat(F.lit('{"c":'), coordinates, F.lit("}")), "c[0]")).otherwise(coordinates)
        new |= {"geom_imcoords": shell, "detection": F.concat(F.lit('{"type":"'), kind, F.lit('","pixelCoordinates":'), coordinates, F.lit("}")), "bounds_imcoords": box}
    there = {n: _get(props, "detection.pixelCoordinates" if n == "detection" else n).isNotNull() for n in new}
    pairs = F.array(*(F.struct(F.lit(n).alias("k"), F.when(there[n], v).alias("v")) for n, v in new.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def control_grid(boxes: DataFrame, key: str, n: int = GRID, margin: float = MARGIN) -> DataFrame:
    """n by n places over all boxes of a group: key, i, j, x, y, with the grid's origin and steps."""
    area = boxes.groupBy(key).agg((F.min("xmin") - margin).alias("x0"), (F.min("ymin") - margin).alias("y0"), (F.max("xmax") + margin).alias("x1"), (F.max("ymax") + margin).alias("y1"))
    area = area.select(key, "x0", "y0", ((F.col("x1") - F.col("x0")) / (n - 1)).alias("dx"), ((F.col("y1") - F.col("y0")) / (n - 1)).alias("dy"))
    cells = area.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return cells.withColumns({"x": F.col("x0") + F.col("i") * F.col("dx"), "y": F.col("y0") + F.col("j") * F.col("dy")})


def packed_grid(grid: DataFrame, key: str, values: list[str], n: int = GRID) -> DataFrame:
    """One row per group: its origin, its steps, and a map of the n * n nodes' values."""
    nodes = F.map_from_entries(F.collect_list(F.struct((F.col("i") * n + F.col("j")).alias("k"), F.struct(*values).alias("v"))))
    return grid.groupBy(key).agg(*(F.first(c).alias(f"_{c}") for c in ("x0", "y0", "dx", "dy")), nodes.alias("_g"))


def interpolate(points: DataFrame, grid: DataFrame, key: str, values: list[str], x: str = "x", y: str = "y", n: int = GRID) -> DataFrame:
    """Points with grid values interpolated between their four neighbours.

    A group's grid is one row of n * n structs, so a point needs one equality join.
    """
    packed = packed_grid(grid, key, values, n)
    joined = points.join(packed, key)
    at = lambda v, o, d: F.greatest(F.lit(0.0), F.least(F.coalesce(F.try_divide(F.col(v) - F.col(o), F.col(d)), F.lit(0.0)), F.lit(float(n - 1))))
    joined = joined.withColumns({"_u": at(x, "_x0", "_dx"), "_v": at(y, "_y0", "_dy")})
    joined = joined.withColumns({"_i": F.least(F.floor("_u"), F.lit(n - 2)), "_j": F.least(F.floor("_v"), F.lit(n - 2))})
    node = lambda a, b, name: F.element_at("_g", ((F.col("_i") + a) * n + F.col("_j") + b).cast("int"))[name]
    fu, fv = F.col("_u") - F.col("_i"), F.col("_v") - F.col("_j")
    made = {v: node(0, 0, v) * (1 - fu) * (1 - fv) + node(1, 0, v) * fu * (1 - fv) + node(0, 1, v) * (1 - fu) * fv + node(1, 1, v) * fu * fv for v in values}
    return joined.select(*points.columns, *(c.alias(v) for v, c in made.items()))


def geolocated_geometries(features: DataFrame, grid: DataFrame, image: str, values: list[str] | None = None, coordinates: str = "coordinates", out: str = "world_coordinates", n: int = GRID) -> DataFrame:
    """Features with the coordinates (JSON text, of any geometry's nesting) of their image geometry in the world.

    Each place becomes [longitude, latitude, and further values of the grid]; the grid has lon and lat in radians.
    A feature needs its image's grid once, whatever the number of its vertices.  Null stays null.
    """
    values = values or ["lon", "lat"]
    number = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
    place = rf"\[\s*{number}(?:\s*,\s*{number})+\s*\]"
    kept = [c for c in features.columns if c != out]
    rows = features.join(packed_grid(grid, image, values, n), image)
    inside = lambda v, o, d: F.greatest(F.lit(0.0), F.least(F.coalesce(F.try_divide(v - F.col(o), F.col(d)), F.lit(0.0)), F.lit(float(n - 1))))
    spots = F.transform(vertices(F.struct(F.col(coordinates).alias("coordinates"))), lambda p: F.struct(inside(p[0], "_x0", "_dx").alias("u"), inside(p[1], "_y0", "_dy").alias("v")))
    cells = F.transform(spots, lambda p: F.struct(p["u"].alias("u"), p["v"].alias("v"), F.least(F.floor(p["u"]), F.lit(n - 2)).alias("i"), F.least(F.floor(p["v"]), F.lit(n - 2)).alias("j")))
    node = lambda p, a, b: F.element_at("_g", ((p["i"] + a) * n + p["j"] + b).cast("int"))
    around = F.transform(cells, lambda p: F.struct((p["u"] - p["i"]).alias("fu"), (p["v"] - p["j"]).alias("fv"), *(node(p, a, b).alias(f"z{a}{b}") for a in (0, 1) for b in (0, 1))))

    def text(p: Column) -> Column:
        made = [p["z00"][v] * (1 - p["fu"]) * (1 - p["fv"]) + p["z10"][v] * p["fu"] * (1 - p["fv"]) + p["z01"][v] * (1 - p["fu"]) * p["fv"] + p["z11"][v] * p["fu"] * p["fv"] for v in values]
        return F.concat(F.lit("["), F.concat_ws(",", *((F.degrees(c) if v in ("lon", "lat") else c).cast("string") for v, c in zip(values, made, strict=True))), F.lit("]"))

    between = F.split(F.col(coordinates), place, -1)
    pieces = F.zip_with(between, F.transform(around, text), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return rows.withColumn(out, F.when(F.col(coordinates).isNotNull(), F.concat_ws("", pieces))).select(*kept, out)


def geolocated_boxes(boxes: DataFrame, grid: DataFrame, image: str, key: str, n: int = GRID) -> DataFrame:
    """Geographic bounds of each box's corners and the place of its centre, in degrees; the grid has lon and lat in radians."""
    c = F.col
    corners = F.array(*(F.struct(F.lit(i).alias("k"), px.alias("x"), py.alias("y")) for i, (px, py) in enumerate([(c("xmin"), c("ymin")), (c("xmin"), c("ymax")), (c("xmax"), c("ymax")), (c("xmax"), c("ymin")), ((c("xmin") + c("xmax")) / 2, (c("ymin") + c("ymax")) / 2)])))
    each = boxes.select(key, image, F.inline(corners))
    found = interpolate(each, grid, image, ["lon", "lat"], n=n).withColumns({"lon": F.degrees("lon"), "lat": F.degrees("lat")})
    edge, centre = F.col("k") < 4, F.col("k") == 4
    return found.groupBy(key).agg(
        *(f(F.when(edge, F.col(a))).alias(f"{w}_{a}") for a in ("lon", "lat") for f, w in ((F.min, "min"), (F.max, "max"))), F.max(F.when(centre, F.col("lon"))).alias("center_longitude"), F.max(F.when(centre, F.col("lat"))).alias("center_latitude")
    )
