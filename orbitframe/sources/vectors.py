"""Vector files: shapefiles as a data source with the rectangle pushed down, and polygons stored by cell so that places read theirs alone."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from orbitframe.operators import geometries as N
from orbitframe.sources.raster_files import THREADS, _skips, _tests, file_system, files

FEATURES = "path string, record int, xmin double, ymin double, xmax double, ymax double, geometry string, properties string"
BOX = ["xmin", "ymin", "xmax", "ymax"]
#: Records of a partition and of an Arrow batch.
RECORDS, BATCH = 50_000, 5_000
#: Fixed codes of the public shapefile format; Z and M forms are ten and twenty above.
POINT, LINES, POLYGON, POINTS, FILE_CODE, HEADER = 1, 3, 5, 8, 9994, 100


def _at(f: BinaryIO, offset: int, n: int) -> bytes:
    f.seek(offset)
    got = f.read(n)
    if len(got) < n:
        raise ValueError("file ends within what its header announces")
    return got


def _opened(path: str) -> BinaryIO:
    fs, inner = file_system(path)
    return fs.open_input_file(inner)


def _beside(path: str, ending: str) -> str | None:
    """The file of the same name with another ending, in either case."""
    base = path[: -len(".shp")]
    for name in (base + ending, base + ending.upper()):
        fs, inner = file_system(name)
        if fs.get_file_info(inner).type == pfs.FileType.File:
            return name
    return None


def _area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def _holds(ring: np.ndarray, place: np.ndarray) -> bool:
    (ax, ay), (bx, by) = ring[:-1].T, ring[1:].T
    up = (ay > place[1]) != (by > place[1])
    return bool((place[0] < ax[up] + (bx - ax)[up] * (place[1] - ay[up]) / (by - ay)[up]).sum() % 2)


def _polygons(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Rings that run clockwise begin a polygon; the others are holes of the smallest of these that holds them, or else polygons of their own."""
    areas = [_area(r) for r in rings]
    outer = [i for i, a in enumerate(areas) if a <= 0]
    made = {i: [rings[i]] for i in outer}
    for i, a in enumerate(areas):
        if a > 0:
            around = [o for o in outer if -areas[o] >= a and _holds(rings[o], rings[i][0])]
            made.setdefault(min(around, key=lambda o: -areas[o]) if around else i, []).append(rings[i])
    return list(made.values())


def shape(data: bytes) -> tuple[tuple[float, float, float, float], dict[str, Any]] | None:
    """Box and GeoJSON geometry of a record's content; None for a null shape."""
    (code,) = struct.unpack("<i", data[:4])
    if code == 0:
        return None
    kind = code % 10
    if code > 28 or kind not in (POINT, LINES, POLYGON, POINTS):
        raise ValueError(f"shapes of type {code} are not read")
    if kind == POINT:
        x, y = struct.unpack("<2d", data[4:20])
        return (x, y, x, y), {"type": "Point", "coordinates": [x, y]}
    box = struct.unpack("<4d", data[4:36])
    if kind == POINTS:
        (n,) = struct.unpack("<i", data[36:40])
        return box, {"type": "MultiPoint", "coordinates": np.frombuffer(data, "<f8", 2 * n, 40).reshape(n, 2).tolist()}
    parts, n = struct.unpack("<2i", data[36:44])
    starts = [*np.frombuffer(data, "<i4", parts, 44).tolist(), n]
    places = np.frombuffer(data, "<f8", 2 * n, 44 + 4 * parts).reshape(n, 2)
    rings = [places[a:b] for a, b in zip(starts, starts[1:], strict=False)]
    if kind == LINES:
        lists = [r.tolist() for r in rings]
        return box, {"type": "LineString", "coordinates": lists[0]} if parts == 1 else {"type": "MultiLineString", "coordinates": lists}
    shells = [[r.tolist() for r in polygon] for polygon in _polygons(rings)]
    return box, {"type": "Polygon", "coordinates": shells[0]} if len(shells) == 1 else {"type": "MultiPolygon", "coordinates": shells}


class Attributes:
    """The table beside a shapefile; its records have one length, so any range of them is read alone."""

    def __init__(self, path: str, first: int, count: int) -> None:
        with _opened(path) as f:
            head = _at(f, 0, 32)
            total, start, self.length = struct.unpack("<IHH", head[4:12])
            fields = _at(f, 32, start - 32)
            self.fields, at = [], 1
            for i in range(0, len(fields) - 31, 32):
                if fields[i] == 0x0D:
                    break
                name = fields[i : i + 11].split(b"\0")[0].decode("latin-1")
                self.fields.append((name, chr(fields[i + 11]), at, fields[i + 16]))
                at += fields[i + 16]
            held = max(0, min(count, total - first))
            self.rows = _at(f, start + first * self.length, held * self.length) if held else b""
        side = _beside(path[:-4] + ".shp", ".cpg")
        self.encoding = "utf-8"
        if side:
            with _opened(side) as f:
                self.encoding = {"": "utf-8", "utf8": "utf-8"}.get(name := f.read(64).decode("latin-1").strip().lower(), name)

    def get(self, i: int) -> str | None:
        """JSON text of the i-th row of the range; a missing row is null."""
        row = self.rows[i * self.length : (i + 1) * self.length]
        if not row:
            return None
        out: dict[str, Any] = {}
        for name, kind, at, width in self.fields:
            text = row[at : at + width].decode(self.encoding, "replace").strip(" \0")
            out[name] = None if not text else text
            if kind in "NF" and text:
                try:
                    out[name] = float(text) if any(c in text for c in ".eE") or kind == "F" else int(text)
                except ValueError:  # stars for a number that did not fit
                    out[name] = None
            elif kind == "L":
                out[name] = {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
            elif kind == "D" and len(text) == 8:
                out[name] = f"{text[:4]}-{text[4:6]}-{text[6:]}"
        return json.dumps(out)


@dataclass
class Range(InputPartition):
    path: str
    first: int
    count: int


class ShapeReader(DataSourceReader):
    """Features of shapefiles.  Comparisons on the box drop whole files by their headers, and records before these are decoded."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.skips, self.records = options["path"], _skips(options), int(options.get("partitionRecords", RECORDS))
        self.tests: list[tuple[str, Any]] = []
        self.bounds: list[tuple[str, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.tests, others = _tests(filters, [*BOX, "record", "path"])
        self.bounds, _ = _tests([f for f in filters if isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))], BOX)
        yield from others

    def _may_hold(self, box: tuple[float, ...]) -> bool:
        """Whether the file may have a record that passes: a bound that any value passes is passed by the least or the greatest."""
        ends = {"x": (box[0], box[2]), "y": (box[1], box[3])}
        return all(any(test(v) for v in ends[name[0]]) for name, test in self.bounds)

    def _ranges(self, path: str) -> list[Range]:
        if not all(test(path) for name, test in self.tests if name == "path"):
            return []
        try:
            with _opened(path) as f:
                head = _at(f, 0, HEADER)
            if struct.unpack(">i", head[:4])[0] != FILE_CODE:
                raise ValueError(f"{path}: not a shapefile")
            index = _beside(path, ".shx")
            if index is None:
                raise ValueError(f"{path}: its index is missing")
            with _opened(index) as f:
                total = (f.size() - HEADER) // 8
        except ValueError:
            if self.skips:
                return []
            raise
        if not self._may_hold(struct.unpack("<4d", head[36:68])):
            return []
        return [Range(path, i, min(self.records, total - i)) for i in range(0, total, self.records)]

    def partitions(self) -> list[InputPartition]:
        with ThreadPoolExecutor(THREADS) as pool:
            return [r for found in pool.map(self._ranges, [p for p in files(self.path) if p.lower().endswith(".shp")]) for r in found]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Range):
            return
        table, rows = _beside(partition.path, ".dbf"), []
        attributes = Attributes(table, partition.first, partition.count) if table else None
        with _opened(_beside(partition.path, ".shx")) as f:
            places = np.frombuffer(_at(f, HEADER + 8 * partition.first, 8 * partition.count), ">i4").reshape(-1, 2).astype(np.int64) * 2
        with _opened(partition.path) as f:
            for i, (at, n) in enumerate(places.tolist()):
                try:
                    row = self._row(f, at + 8, n, partition.path, partition.first + i)
                except (ValueError, struct.error, IndexError) as e:
                    if self.skips:
                        continue
                    raise ValueError(f"{partition.path}, record {partition.first + i}: {e}") from e
                if row is not None:
                    rows.append((*row, attributes.get(i) if attributes else None))
                if len(rows) == BATCH:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    def _row(self, f: BinaryIO, at: int, n: int, path: str, record: int) -> tuple | None:
        data = _at(f, at, n)
        (code,) = struct.unpack("<i", data[:4])
        box = (None,) * 4 if code == 0 else struct.unpack("<2d", data[4:20]) * 2 if code % 10 == POINT else struct.unpack("<4d", data[4:36])
        values = dict(zip(BOX, box, strict=True)) | {"record": record}
        if not all(values[name] is not None and test(values[name]) for name, test in self.tests if name != "path"):
            return None
        found = shape(data)
        return (path, record, *box, json.dumps(found[1]) if found else None)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), *[pa.float64()] * 4, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "record", *BOX, "geometry", "properties"])


class Shapefiles(DataSource):
    """Format shapefiles.  Options: path, corrupt (fail, or skip damaged files and records), partitionRecords."""

    @classmethod
    def name(cls) -> str:
        return "shapefiles"

    def schema(self) -> str:
        return FEATURES

    def reader(self, schema: Any) -> ShapeReader:
        return ShapeReader(self.options)


def read_shapefiles(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """Features of the shapefiles of a path: geometry and properties as JSON text.  A null shape has a null geometry; attributes beyond the table's end are null."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Shapefiles)
    return spark.read.format("shapefiles").options(**options).load(path)


def within(features: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Features whose box meets a rectangle; the bounds reach the reader as filters."""
    c = F.col
    return features.where((c("xmin") <= float(xmax)) & (c("xmax") >= float(xmin)) & (c("ymin") <= float(ymax)) & (c("ymax") >= float(ymin)))


# Polygons stored by cell.

#: Cells along the side of a stored part, and files over which the polygons of one are dealt.
PER, SPREAD = 16, 4
#: Parts asked for that are broadcast to prune the table: two numbers each.
ASKED = 200_000


def _part_of(cell: str) -> Column:
    return F.floor(F.col(cell) / PER).cast("long")


def _cells(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The stored cells; the schema is given, as a table without polygons has no files."""
    edge = "struct<ax:double,ay:double,bx:double,by:double>"
    return spark.read.schema(f"key {kind}, part int, cell_x long, cell_y long, inside boolean, edges array<{edge}>, level int, part_x long, part_y long").parquet(f"{path}/cells")


def store_polygons(features: DataFrame, path: str, key: str, geometry: str = "geometry", size: float = 1.0, mode: str = "errorifexists") -> None:
    """The covering of the polygons of GeoJSON features: path/cells, partitioned by size of cell and part of the plane, and path/levels, the sizes in use."""
    cells = N.covering(features.select(key, N.parts_of(F.col(geometry)).alias("parts")), key, size=size)
    rows = cells.withColumns({"part_x": _part_of("cell_x"), "part_y": _part_of("cell_y"), "_deal": F.pmod(F.xxhash64("key"), F.lit(SPREAD))})
    rows.repartition("level", "part_x", "part_y", "_deal").drop("_deal").sortWithinPartitions("level", "part_x", "part_y", "cell_x", "cell_y").write.mode(mode).partitionBy("level", "part_x", "part_y").parquet(f"{path}/cells")
    kind = features.schema[key].dataType.simpleString()
    _cells(features.sparkSession, path, kind).select("level").distinct().coalesce(1).withColumn("key", F.lit(None).cast(kind)).write.mode(mode).parquet(f"{path}/levels")


def stored_holders(points: DataFrame, path: str, x: str, y: str, limit: int = ASKED) -> DataFrame:
    """Points with key and part of every stored polygon that holds them.

    The parts of the plane with points, where they are no more than limit, are broadcast and prune the table's partitions
    while it is scanned; beyond that all parts of a size are read.
    """
    spark, found = points.sparkSession, []
    levels = spark.read.parquet(f"{path}/levels")
    kind = levels.schema["key"].dataType.simpleString()
    table = _cells(spark, path, kind)
    for level in N.levels(levels):
        step = 2.0**level
        placed = N.at_level(points, x, y, level).withColumns({"part_x": _part_of("cell_x"), "part_y": _part_of("cell_y")})
        here = table.where(F.col("level") == level).drop("level")
        asked = placed.where((F.abs(F.col(x)) < step * 2**52) & (F.abs(F.col(y)) < step * 2**52)).select("part_x", "part_y").distinct()
        if asked.limit(limit + 1).count() <= limit:
            here = here.join(F.broadcast(asked), ["part_x", "part_y"], "left_semi")
        joined = placed.join(here, ["part_x", "part_y", "cell_x", "cell_y"]).where(N.held(F.col(x), F.col(y)))
        found.append(joined.select(*points.columns, "key", "part"))
    return reduce(DataFrame.unionByName, found) if found else points.withColumns({"key": F.lit(None).cast(kind), "part": F.lit(None).cast("int")}).limit(0)
