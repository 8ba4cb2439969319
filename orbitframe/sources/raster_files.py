"""Raster files as a Spark data source: blocks read with filters pushed to them, and tiles written with commit and abort.

Paths are URIs that Arrow's file systems know, or local ones that all executors share.  Rows of blocks have the columns of
operators.blocks, so windows, overviews and orthophotos work on files as on tables.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from orbitframe.operators.blocks import BLOCK
from orbitframe.sources import raster_formats as R

BLOCKS = "image string, segment int, band int, level int, block_y int, block_x int, top int, left int, height int, width int, v array<double>"
INFO = "image string, kind string, segment int, level int, width int, height int, block_width int, block_height int, bands int, gt array<double>, no_data double, xml string, extensions array<struct<name: string, data: binary>>, error string"
INFO_COLUMNS = ["image", "kind", "segment", "level", "width", "height", "block_width", "block_height", "bands", "gt", "no_data", "xml", "extensions", "error"]
PLACE = ["image", "segment", "band", "level", "block_y", "block_x", "top", "left", "height", "width"]
#: Bytes of values (eight each) in a partition, and threads that read headers while a query is planned.
PARTITION_BYTES, THREADS = 64 << 20, 16
#: With more files than that the small ones, of this share of a partition's bytes at most, go to tasks by so many, unopened.
MANY, SMALL, TOGETHER = 1000, 8, 500


def file_system(path: str) -> tuple[pfs.FileSystem, str]:
    """Arrow's file system of a URI or a local path, and the path in it."""
    if path.startswith("file:"):
        return pfs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pfs.FileSystem.from_uri(path) if "://" in path else (pfs.LocalFileSystem(), os.path.abspath(path))


def sized_files(path: str) -> list[tuple[str, int]]:
    """The file, or the files below a folder, with their bytes; names that begin with _ or . are not data."""
    fs, inner = file_system(path)
    info = fs.get_file_info(inner)
    if info.type == pfs.FileType.File:
        return [(path, info.size)]
    prefix = path.rstrip("/")
    below = [(i.path[len(inner.rstrip("/")) + 1 :], i.size) for i in fs.get_file_info(pfs.FileSelector(inner, recursive=True)) if i.type == pfs.FileType.File]
    return [(f"{prefix}/{b}", size) for b, size in sorted(below) if not any(p[:1] in "_." for p in b.split("/"))]


def files(path: str) -> list[str]:
    """The paths of sized_files."""
    return [p for p, _ in sized_files(path)]


def grids(path: str) -> list[R.Grid]:
    fs, inner = file_system(path)
    with fs.open_input_file(inner) as f:
        return R.layout(f, f.size())


def _skips(options: dict[str, str]) -> bool:
    how = options.get("corrupt", "fail")
    if how not in ("fail", "skip"):
        raise ValueError("corrupt is fail or skip")
    return how == "skip"


def _tests(filters: list[Filter], known: list[str]) -> tuple[list[tuple[str, Any]], list[Filter]]:
    """Filters on known columns as tests of a value, and the others."""
    kinds = {EqualTo: lambda v: lambda x: x == v, In: lambda v: lambda x: x in v, GreaterThan: lambda v: lambda x: x > v, GreaterThanOrEqual: lambda v: lambda x: x >= v, LessThan: lambda v: lambda x: x < v, LessThanOrEqual: lambda v: lambda x: x <= v}
    mine, others = [], []
    for f in filters:
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if type(f) in kinds and name in known and f.value is not None:
            mine.append((name, kinds[type(f)](f.value)))
        else:
            others.append(f)
    return mine, others


def _places(path: str, grid: R.Grid, i: int, bands: range | None = None) -> list[dict[str, Any]]:
    left, top, width, height = grid.size_of(i)
    base = {"image": path, "segment": grid.segment, "level": grid.level, "block_y": i // grid.across, "block_x": i % grid.across, "top": top, "left": left, "height": height, "width": width}
    return [base | {"band": b + 1} for b in (range(grid.bands) if bands is None else bands)]


@dataclass
class Chosen(InputPartition):
    """Blocks of one grid of a file: number, bands asked for and parts; the grid itself goes without parts."""

    path: str
    grid: R.Grid
    blocks: list[tuple[int, list[int], list[R.Part]]]


@dataclass
class Unopened(InputPartition):
    """Small files, whose headers are read where their blocks are."""

    paths: list[str]


def _batch(path: str, grid: R.Grid, i: int, bands: list[int], values: np.ndarray) -> pa.RecordBatch:
    rows = _places(path, grid, i, bands)
    size = values.shape[1] * values.shape[2]
    v = pa.ListArray.from_arrays(np.arange(0, size * len(bands) + 1, size, dtype=np.int32), pa.array(np.ascontiguousarray(values[bands]).ravel()))
    kinds = {"image": pa.string()}
    return pa.RecordBatch.from_arrays([*(pa.array([r[n] for r in rows], kinds.get(n, pa.int32())) for n in PLACE), v], [*PLACE, "v"])


class BlockReader(DataSourceReader):
    """Blocks of files.  Headers are read while the query is planned, those of many small files in tasks, several files a
    task; pixels only of blocks that the filters leave."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.skips = options["path"], _skips(options)
        self.limit = int(options.get("partitionBytes", PARTITION_BYTES))
        self.tests: list[tuple[str, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.tests, others = _tests(filters, PLACE)
        yield from others

    def _chosen(self, path: str) -> list[Chosen]:
        if not all(test(path) for name, test in self.tests if name == "image"):
            return []
        try:
            found = grids(path)
        except ValueError as e:
            if self.skips:
                return []
            raise ValueError(f"{path}: {e}") from e
        out = []
        for grid in found:
            bare = replace(grid, parts=[], records=[], extensions=[])
            here: list[tuple[int, list[int], list[R.Part]]] = []
            held = 0
            for i in range(len(grid.parts)):
                bands = [p["band"] - 1 for p in _places(path, grid, i) if all(test(p[name]) for name, test in self.tests)]
                if not bands:
                    continue
                _, _, width, height = grid.size_of(i)
                if here and held + width * height * grid.bands * 8 > self.limit:
                    out.append(Chosen(path, bare, here))
                    here, held = [], 0
                here.append((i, bands, grid.parts[i]))
                held += width * height * grid.bands * 8
            if here:
                out.append(Chosen(path, bare, here))
        return out

    def partitions(self) -> list[InputPartition]:
        found = [(path, size) for path, size in sized_files(self.path) if all(test(path) for name, test in self.tests if name == "image")]
        small = [f for f in found if f[1] <= self.limit // SMALL] if len(found) > MANY else []
        out: list[InputPartition] = []
        held = 0
        for path, size in small:
            if not out or len(out[-1].paths) == TOGETHER or held + size > self.limit:
                out.append(Unopened([]))
                held = 0
            out[-1].paths.append(path)
            held += size
        rest = [path for path, size in found if not small or size > self.limit // SMALL]
        with ThreadPoolExecutor(THREADS) as pool:
            return out + [c for chosen in pool.map(self._chosen, rest) for c in chosen]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Unopened):
            for path in partition.paths:
                for chosen in self._chosen(path):
                    yield from self._blocks(chosen)
        elif isinstance(partition, Chosen):  # else no block is left
            yield from self._blocks(partition)

    def _blocks(self, partition: Chosen) -> Iterator[pa.RecordBatch]:
        fs, inner = file_system(partition.path)
        with fs.open_input_file(inner) as f:
            for i, bands, parts in partition.blocks:
                try:
                    values = R.block(f, partition.grid, i, parts)
                except ValueError as e:
                    if self.skips:
                        continue
                    raise ValueError(f"{partition.path}: {e}") from e
                yield _batch(partition.path, partition.grid, i, bands, values)


class RasterBlocks(DataSource):
    """Format raster_blocks.  Options: path, corrupt (fail, or skip damaged files and blocks), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "raster_blocks"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema: Any) -> BlockReader:
        return BlockReader(self.options)


def read_blocks(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """Blocks of the raster files of a path, through the data source, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterBlocks)
    return spark.read.format("raster_blocks").options(**options).load(path)


def read_info(paths: DataFrame, corrupt: str = "fail") -> DataFrame:
    """A row per grid of the files of a column path: sizes, geotransform, tagged records as XML, extension segments.

    Files are opened in tasks.  A damaged file is an error, or with corrupt="skip" a row with its error and nulls.
    """
    skips = _skips({"corrupt": corrupt})
    names = INFO_COLUMNS

    def rows(path: str) -> list[tuple]:
        try:
            found = grids(path)
        except ValueError as e:
            if not skips:
                raise ValueError(f"{path}: {e}") from e
            return [(path, *[None] * (len(names) - 2), str(e))]
        return [(path, g.kind, g.segment, g.level, g.width, g.height, g.block_width, g.block_height, g.bands, g.gt, g.no_data, R.record_xml(g.records) if g.records else None, [{"name": n, "data": d} for n, d in g.extensions], None) for g in found]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = pd.DataFrame([r for p in b["path"] for r in rows(p)], columns=names)
            yield made.astype(dict.fromkeys(["segment", "level", "width", "height", "block_width", "block_height", "bands"], "Int32"))

    return paths.select("path").where("path is not null").mapInPandas(run, INFO)


def read_listed(paths: DataFrame, where: Column | None = None, corrupt: str = "fail") -> DataFrame:
    """Blocks of the files of a column path, for more files than a driver should open: headers are read in tasks too.

    One pass lists the blocks, where chooses among them by their place, and a second, dealt out by file and row of blocks,
    reads them.
    """
    skips = _skips({"corrupt": corrupt})

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                try:
                    found = grids(path)
                except ValueError as e:
                    if skips:
                        continue
                    raise ValueError(f"{path}: {e}") from e
                for g in found:
                    yield pd.DataFrame([p for i in range(len(g.parts)) for p in _places(path, g, i)], columns=PLACE)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[R.Grid]] = {}
        for b in batches:
            for (path, segment, level, by, bx), rows in pa.Table.from_batches([b]).to_pandas().groupby(["image", "segment", "level", "block_y", "block_x"], sort=False):
                if path not in known:
                    known = {path: grids(path)}
                g = next(g for g in known[path] if (g.segment, g.level) == (segment, level))
                fs, inner = file_system(path)
                with fs.open_input_file(inner) as f:
                    try:
                        values = R.block(f, g, by * g.across + bx, g.parts[by * g.across + bx])
                    except ValueError as e:
                        if skips:
                            continue
                        raise ValueError(f"{path}: {e}") from e
                yield _batch(path, g, by * g.across + bx, [band - 1 for band in rows["band"]], values)

    places = paths.select("path").where("path is not null").mapInPandas(listed, BLOCKS.rsplit(", ", 1)[0])
    kept = places.where(where) if where is not None else places
    return kept.repartition("image", "segment", "level", "block_y").sortWithinPartitions("image", "segment", "level", "block_y", "block_x").mapInArrow(read, BLOCKS)


def elevation_tiles(blocks: DataFrame, info: DataFrame) -> DataFrame:
    """Elevation tiles (tile_id, width, height, gt, z, no_data) as read_tiles gives them, of one-band files of level 0; a tile is one file."""
    whole = info.where("level = 0 and segment = 0 and error is null").select("image", F.col("width").alias("_w"), F.col("height").alias("_h"), "gt", F.coalesce("no_data", F.lit(-9999.0)).alias("no_data"))
    schema = "tile_id string, width int, height int, gt array<double>, z array<double>, no_data double"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        out = np.full((first["_h"], first["_w"]), first["no_data"])
        for top, left, h, w, v in zip(rows["top"], rows["left"], rows["height"], rows["width"], rows["v"], strict=True):
            out[top : top + h, left : left + w] = v.reshape(h, w)
        name = posixpath.splitext(posixpath.basename(key[0]))[0]
        return pd.DataFrame([(name, first["_w"], first["_h"], first["gt"], out.ravel(), first["no_data"])], columns=["tile_id", "width", "height", "gt", "z", "no_data"])

    return blocks.where("level = 0 and segment = 0 and band = 1").join(whole, "image").groupBy("image").applyInPandas(run, schema)


# The sink.


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task's files, and their number."""

    folder: str
    number: int


class TileWriter(DataSourceWriter):
    """Each task writes to a folder of its own below _pending; commit moves these folders, abort removes them.

    So a failed or repeated task leaves nothing, and the driver handles one name per task.
    """

    def __init__(self, options: dict[str, str], columns: list[str], overwrite: bool) -> None:
        self.path, self.overwrite, self.columns = options["path"].rstrip("/"), overwrite, columns
        self.kind, self.compress = options.get("fileformat", "gtiff"), options.get("compression", "deflate")
        if self.kind not in ("gtiff", "nitf") or self.compress not in ("deflate", "none"):
            raise ValueError("fileFormat is gtiff or nitf, compression is deflate or none")
        missing = {"name", "width", "height", "bands", "kind", "v"} - set(columns)
        if missing:
            raise ValueError(f"tiles lack the columns {sorted(missing)}")
        self.job = uuid.uuid4().hex

    def _file(self, row: dict[str, Any]) -> bytes:
        pixels = np.asarray(row["v"], float).reshape(row["bands"], row["height"], row["width"])
        dtype = np.dtype(row["kind"])
        if dtype.kind in "ui":
            pixels = np.clip(np.rint(pixels), np.iinfo(dtype).min, np.iinfo(dtype).max)
        pixels = pixels.astype(dtype)
        if self.kind == "gtiff":
            return R.tiff_file(pixels, row.get("gt"), compress=self.compress)
        extensions = [(d["name"], bytes(d["data"])) for d in row.get("extensions") or ()]
        records = [(d["name"], bytes(d["data"])) for d in row.get("records") or ()]
        return R.nitf_file(pixels, row.get("igeolo"), records, extensions)

    def write(self, iterator: Iterator[Any]) -> Written:
        folder, number = f"{self.job}-{uuid.uuid4().hex}", 0
        fs, inner = file_system(self.path)
        place = posixpath.join(inner, "_pending", folder)
        seen: set[str] = set()
        for row in iterator:
            r = row.asDict(recursive=True)
            name = r["name"]
            if not name or "/" in name or name[0] in "_.":
                raise ValueError(f"no name of a file: {name!r}")
            if name in seen:
                raise ValueError(f"two tiles are named {name}")
            seen.add(name)
            if not number:
                fs.create_dir(place, recursive=True)
            with fs.open_output_stream(posixpath.join(place, f"{name}.{'tif' if self.kind == 'gtiff' else 'ntf'}")) as f:
                f.write(self._file(r))
            number += 1
        return Written(folder, number)

    def commit(self, messages: list[Written | None]) -> None:
        fs, inner = file_system(self.path)
        fs.create_dir(inner, recursive=True)
        if self.overwrite:
            for found in fs.get_file_info(pfs.FileSelector(inner)):
                if posixpath.basename(found.path) != "_pending":
                    (fs.delete_dir if found.type == pfs.FileType.Directory else fs.delete_file)(found.path)
        for m in messages:
            if m is not None and m.number:
                fs.move(posixpath.join(inner, "_pending", m.folder), posixpath.join(inner, m.folder))
        self._clean(fs, inner)
        with fs.open_output_stream(posixpath.join(inner, "_SUCCESS")):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        fs, inner = file_system(self.path)
        self._clean(fs, inner)

    def _clean(self, fs: pfs.FileSystem, inner: str) -> None:
        """Remove what this job left: also folders of attempts that never reported."""
        pending = posixpath.join(inner, "_pending")
        if fs.get_file_info(pending).type == pfs.FileType.Directory:
            found = fs.get_file_info(pfs.FileSelector(pending))
            mine = [f.path for f in found if posixpath.basename(f.path).startswith(self.job)]
            for path in mine:
                fs.delete_dir(path)
            if len(mine) == len(found):
                fs.delete_dir(pending)


class RasterTiles(DataSource):
    """Format raster_tiles, a sink of rows name, width, height, bands, kind (a numpy type such as uint8) and v, bands one after another.

    Options: path, fileFormat (gtiff or nitf), compression (of gtiff: deflate or none).  Columns gt, and for NITF igeolo,
    records and extensions (arrays of name and data), are used if they are there; others are not.
    """

    @classmethod
    def name(cls) -> str:
        return "raster_tiles"

    def writer(self, schema: Any, overwrite: bool) -> TileWriter:
        return TileWriter(self.options, schema.names, overwrite)


def write_tiles(tiles: DataFrame, path: str, file_format: str = "gtiff", mode: str = "append", **options: Any) -> None:
    """Write tiles as files, one each."""
    spark = tiles.sparkSession
    spark.dataSource.register(RasterTiles)
    tiles.write.format("raster_tiles").mode(mode).options(fileFormat=file_format, **options).save(path)


def chips(blocks: DataFrame, kind: str = "uint8", images: DataFrame | None = None, size: int = BLOCK) -> DataFrame:
    """Blocks as tiles of all their bands, which write_tiles takes: a block of an image and level becomes one file.

    With images (image, gt) a tile has the geotransform of its first pixel; an overview's pixels are larger by powers of two.
    """
    keys = ["image", "level", "block_y", "block_x"]
    text = F.col("image").cast("string")
    name = F.concat_ws("_", F.regexp_replace(text, r"^.*/|[^A-Za-z0-9.-]", ""), F.hex(F.crc32(text.cast("binary"))), "level", "block_y", "block_x")
    bands = F.array_sort(F.collect_list(F.struct("band", "v")))
    same = lambda n: F.when(F.min(n) == F.max(n), F.max(n)).otherwise(F.raise_error(F.lit("bands of a block differ in size")).cast("int"))
    rows = blocks.groupBy(*keys).agg(same("width").alias("width"), same("height").alias("height"), bands.alias("_bands"))
    gt = F.lit(None).cast("array<double>")
    if images is not None:
        rows = rows.join(images.select("image", F.col("gt").alias("_gt")), "image", "left")
        step, g = F.pow(F.lit(2.0), "level"), F.col("_gt")
        left, top = F.col("block_x") * size * step, F.col("block_y") * size * step
        gt = F.when(g.isNotNull(), F.array(g[0] + left * g[1] + top * g[2], g[1] * step, g[2] * step, g[3] + left * g[4] + top * g[5], g[4] * step, g[5] * step))
    return rows.select(F.concat(F.lit("t"), name).alias("name"), *keys, "width", "height", F.size("_bands").alias("bands"), F.lit(kind).alias("kind"), gt.alias("gt"), F.flatten(F.col("_bands.v")).alias("v"))
