"""Where contours meet terrain, found by least and greatest heights of blocks instead of by every step.

A contour's height rises from its low to its high point.  Its steps are taken in sections of hundreds, then fewer, then
single steps; of each only the ends are worked out, and a section whose heights lie wholly above or below the terrain of
the blocks around it is dropped.  Blocks of several sizes have their bounds in one table, so a section asks for one row.
A section is settled as soon as the posts around it lie in one block of one tile: it takes along these few posts, and
its steps are walked in Arrow batches and never become rows.  What goes from one tile to another is split down to single
steps, whose ends ask for their elevations by joins.  Each round is written once, as several parts read it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.functions.projective import affine_inverse
from orbitframe.lineage import cut, dealt, written
from orbitframe.operators import elevation as E
from orbitframe.operators import sar

#: Steps of the sections, from coarse to fine.
SECTIONS = (256, 16, 4, 1)
#: Rounds in which the meeting within a step is moved nearer by a secant.
ROUNDS = 2
#: What a point of a contour is made of.
CIRCLE = [n for n in sar.TRACK if n != "_n"]
#: Nearer to the poles, in degrees, lines of posts bend too much for a section's ends to tell the posts around it.
STRAIGHT = 89.5
#: Steps that are worked out at once in a task, and less than the earth's least radius of curvature.
AT_ONCE, CURVE = 500_000, 6.3e6


def height_bounds(blocks: DataFrame, levels: int) -> DataFrame:
    """tile_id, level, brow, bcol, least and most of the elevations in and around blocks of 2^level blocks a side.

    blocks come from elevation.cut_blocks.  A block's bounds are those of three by three blocks, so that they hold for
    whatever begins in it and is no longer than it.  Posts without data are left out.
    """
    known = F.filter("posts", lambda z: z.isNotNull() & ~F.isnan(z) & ~z.eqNullSafe(F.col("no_data")))
    here = blocks.select("tile_id", "brow", "bcol", F.array_min(known).alias("least"), F.array_max(known).alias("most")).where("least is not null")
    out = None
    for level in range(levels):
        around = here.withColumn("brow", F.explode(F.array(*(F.col("brow") + d for d in (-1, 0, 1))))).withColumn("bcol", F.explode(F.array(*(F.col("bcol") + d for d in (-1, 0, 1)))))
        grown = around.groupBy("tile_id", "brow", "bcol").agg(F.min("least").alias("least"), F.max("most").alias("most")).select("tile_id", F.lit(level).alias("level"), "brow", "bcol", "least", "most")
        out = grown if out is None else out.unionByName(grown)
        here = here.groupBy("tile_id", F.floor(F.col("brow") / 2).cast("int").alias("brow"), F.floor(F.col("bcol") / 2).cast("int").alias("bcol")).agg(F.min("least").alias("least"), F.max("most").alias("most"))
    return out


def _numbers(rows: pa.Array | pa.RecordBatch) -> dict[str, np.ndarray]:
    """Columns of numbers, nulls as not a number."""
    found = zip([f.name for f in rows.type], rows.flatten(), strict=True) if isinstance(rows, pa.Array) else zip(rows.schema.names, rows.columns, strict=True)
    return {n: v.to_numpy(zero_copy_only=False).astype(float) for n, v in found}


def _circle(c: dict[str, np.ndarray], cos: np.ndarray) -> np.ndarray:
    """Places of contours at cosines, as sar._on_contour."""
    sin = c["_sign"] * np.sqrt(1 - cos * cos)
    return np.stack([c[f"_ctr_{a}"] + (c[f"_rx_{a}"] * cos + c[f"_ry_{a}"] * sin) * c["_rad"] for a in "xyz"], 1)


def _degrees(c: dict[str, np.ndarray], cos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with np.errstate(all="ignore"):
        lon, lat, height = sar._geodetic(_circle(c, cos))
    return np.degrees(lon), np.degrees(lat), height


def _section_ends(rows: pa.Array) -> pa.Array:
    c = _numbers(rows)
    ends = [v for s in ("_s0", "_s1") for v in _degrees(c, c["_cb"] + c[s] * c["_step"])]
    return pa.StructArray.from_arrays([pa.array(v, from_pandas=True) for v in ends], [f"_{n}{end}" for end in "01" for n in ("lon", "lat", "h")])


def _section_place(rows: pa.Array) -> pa.Array:
    c = _numbers(rows)
    return pa.StructArray.from_arrays([pa.array(v, from_pandas=True) for v in _degrees(c, c["_cm"])], ["_lonm", "_latm", "_hm"])


def _sign(side: str) -> Column:
    return F.when(F.col(side) == "L", 1.0).otherwise(-1.0).alias("_sign")


def _ends(df: DataFrame, side: str) -> DataFrame:
    """Adds longitude and latitude in degrees and height of a section's ends."""
    ends = F.arrow_udf(_section_ends, ", ".join(f"_{n}{end} double" for end in "01" for n in ("lon", "lat", "h")))
    return df.withColumn("_e", ends(F.struct(*CIRCLE, _sign(side), "_s0", "_s1"))).select(*df.columns, "_e.*")


def _ruled(df: DataFrame, bounds: DataFrame, headers: DataFrame, tile: Callable[[Column, Column], Column], levels: int, size: int) -> DataFrame:
    """Sections that the bounds around them don't rule out, with _tile, the posts around them (_row0 to _col1) and whether they are settled.

    Those that go from one tile to another stay.
    """
    c = F.col
    head = headers.select(c("tile_id").alias("_tile"), c("gt").alias("_gt"), c("width").alias("_w"), c("height").alias("_hh"))
    rows = df.withColumns({"_tile": tile(c("_lon0"), c("_lat0")), "_other": tile(c("_lon1"), c("_lat1"))}).join(head, "_tile", "left")
    inside = lambda v, n: F.greatest(F.lit(0.0), F.least(v, (n - 1).cast("double")))
    for end in "01":
        x, y = affine_inverse(c("_gt"), c(f"_lon{end}"), c(f"_lat{end}"))
        rows = rows.withColumns({f"_x{end}": inside(x, c("_w")), f"_y{end}": inside(y, c("_hh"))})
    known = c("_x0").isNotNull() & c("_x1").isNotNull()  # the others' would be posts of nowhere
    extent = F.greatest(F.abs(c("_x1") - c("_x0")), F.abs(c("_y1") - c("_y0"))) + 2
    level = F.greatest(F.lit(0), F.ceil(F.log2(extent / size))).cast("int")
    rows = rows.withColumn("_level", F.when(known, level))
    block = lambda v: F.floor(c(v) / (size * F.pow(F.lit(2.0), "_level"))).cast("int")
    rows = rows.withColumns({"_brow": block("_y0"), "_bcol": block("_x0")})
    around = bounds.select(c("tile_id").alias("_tile"), c("level").alias("_level"), c("brow").alias("_brow"), c("bcol").alias("_bcol"), "least", "most")
    joined = rows.join(around, ["_tile", "_level", "_brow", "_bcol"], "left")
    meets = (F.least("_h0", "_h1") <= c("most") + sar.ON_SURFACE) & (F.greatest("_h0", "_h1") >= c("least") - sar.ON_SURFACE)
    joined = joined.where(meets | ~c("_other").eqNullSafe(c("_tile")) | (c("_level") >= levels))
    low = lambda v: F.greatest(F.lit(0), F.floor(F.least(f"{v}0", f"{v}1")).cast("int") - 1)
    high = lambda v, n: F.least(c(n) - 1, F.floor(F.greatest(f"{v}0", f"{v}1")).cast("int") + 2)
    joined = joined.withColumns({"_row0": F.when(known, low("_y")), "_row1": F.when(known, high("_y", "_hh")), "_col0": F.when(known, low("_x")), "_col1": F.when(known, high("_x", "_w"))})
    fits = lambda v: c(f"{v}1") <= (F.floor(c(f"{v}0") / size) + 2) * size
    settled = c("_tile").eqNullSafe(c("_other")) & fits("_row") & fits("_col") & (F.greatest(F.abs("_lat0"), F.abs("_lat1")) < STRAIGHT)
    return joined.withColumn("_settled", F.coalesce(settled, F.lit(False))).select(*df.columns, "_tile", "_row0", "_row1", "_col0", "_col1", "_settled")


def _may_meet(df: DataFrame, bounds: DataFrame, headers: DataFrame, tile: Callable[[Column, Column], Column], levels: int, size: int) -> DataFrame:
    """Sections that the bounds around them don't rule out; those that go from one tile to another stay."""
    return _ruled(df, bounds, headers, tile, levels, size).select(*df.columns)


class _Windows:
    """The posts around each row's section, and elevations between them as elevation.sample has them."""

    def __init__(self, batch: pa.RecordBatch, c: dict[str, np.ndarray]) -> None:
        posts = batch.column("_posts")
        self.start, self.c = posts.offsets.to_numpy()[:-1] - posts.offsets[0].as_py(), c
        self.posts = posts.flatten().to_numpy(zero_copy_only=False).astype(float)
        self.posts[self.posts == np.repeat(c["no_data"], np.diff(posts.offsets.to_numpy()))] = np.nan
        self.least, self.most = np.fmin.reduceat(self.posts, self.start), np.fmax.reduceat(self.posts, self.start)

    def elevation(self, of: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """At places of the rows of; not a number where a post is missing."""
        n = {k: self.c[k][of] for k in ("_g0", "_g1", "_g2", "_g3", "_g4", "_g5", "width", "height", "_row0", "_row1", "_col0", "_col1")}
        det, dx, dy = n["_g1"] * n["_g5"] - n["_g2"] * n["_g4"], lon - n["_g0"], lat - n["_g3"]
        x = np.clip((n["_g5"] * dx - n["_g2"] * dy) / det, 0, n["width"] - 1)
        y = np.clip((n["_g1"] * dy - n["_g4"] * dx) / det, 0, n["height"] - 1)
        col, row = (np.maximum(0, np.minimum(np.floor(v), n[k] - 2)) for v, k in ((x, "width"), (y, "height")))
        fx, fy = x - col, y - row
        if np.any((col < n["_col0"]) | (row < n["_row0"]) | (col + (fx > 0) > n["_col1"]) | (row + (fy > 0) > n["_row1"])):
            raise ValueError("a section leaves the posts around its ends")
        wide = n["_col1"] - n["_col0"] + 1

        def post(dr: int, dc: int) -> np.ndarray:
            r, k = np.minimum(row + dr, n["_row1"]) - n["_row0"], np.minimum(col + dc, n["_col1"]) - n["_col0"]
            return self.posts[self.start[of] + (r * wide + k).astype(np.int64)]

        # a post that has no weight is not asked for
        mixed = lambda a, b, f: np.where(f == 0, a, np.where(f == 1, b, a * (1 - f) + b * f))
        return mixed(mixed(post(0, 0), post(0, 1), fx), mixed(post(1, 0), post(1, 1), fx), fy)


def _steps(c: dict[str, np.ndarray], least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each section's steps between which its height can pass the posts'.

    A height differs from the straight line between those of the ends by an eighth of its second derivative at most.
    """
    n, rise = c["_s1"] - c["_s0"], c["_h1"] - c["_h0"]
    cos = np.stack([c["_cb"] + c[s] * c["_step"] for s in ("_s0", "_s1")])
    sin = np.sqrt(np.maximum(0, 1 - cos * cos)).min(0)
    along = c["_rad"] * c["_step"] / sin
    slack = n * n / 4 * (c["_rad"] * c["_step"] ** 2 / sin**3 + along * along / CURVE) + 2 * sar.ON_SURFACE
    first = np.floor((least - slack - c["_h0"]) / rise * n)
    last = np.ceil((most + slack - c["_h0"]) / rise * n)
    whole = ~((rise > 0) & np.isfinite(first) & np.isfinite(last))
    first, last = np.where(whole, 0, np.clip(first, 0, n)), np.where(whole, n, np.clip(last, 0, n))
    none = np.isnan(least)
    return c["_s0"] + np.where(none, 0, first), c["_s0"] + np.where(none, 0, last)


def _first_meetings(c: dict[str, np.ndarray], posts: _Windows, rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows that meet the terrain: the row, the step before, and the place, not a number where a post is missing."""
    counts = (last - first).astype(np.int64) + 1
    of = np.repeat(rows, counts)
    step = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
    some = {k: c[k] for k in (*CIRCLE, "_sign")}

    def above(at: np.ndarray, cos: np.ndarray) -> np.ndarray:
        lon, lat, height = _degrees({k: v[at] for k, v in some.items()}, cos)
        return height - posts.elevation(at, lon, lat)

    d = above(of, c["_cb"][of] + step * c["_step"][of])
    d0, d1 = d[:-1], d[1:]
    flat = lambda v: np.abs(v) < sar.ON_SURFACE
    hit = np.flatnonzero((of[:-1] == of[1:]) & ~np.isnan(d0) & ~np.isnan(d1) & (flat(d0) | flat(d1) | (d0 * d1 < 0)))
    met, place = np.unique(of[hit], return_index=True)
    hit = hit[place]
    d0, d1, before = d0[hit], d1[hit], step[hit]
    c0, c1 = (c["_cb"][met] + s * c["_step"][met] for s in (before, before + 1))
    part = lambda: c0 + np.clip(np.where(d0 == d1, 0, d0 / (d0 - d1)), 0, 1) * (c1 - c0)
    missing = np.zeros(len(met), bool)
    for _ in range(ROUNDS):
        middle = part()
        dm = above(met, middle)
        missing |= np.isnan(dm)
        low = np.sign(dm) == np.sign(d0)
        # the nearer end is replaced, so the next secant is taken over a shorter stretch
        c0, d0, c1, d1 = np.where(low, middle, c0), np.where(low, dm, d0), np.where(low, c1, middle), np.where(low, d1, dm)
    point = _circle({k: v[met] for k, v in some.items()}, part())
    point[missing] = np.nan
    return met, before, point


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first meeting of each settled section that has one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        c = _numbers(batch.drop_columns(["_key", "_posts"]))
        with np.errstate(all="ignore"):
            posts = _Windows(batch, c)
            first, last = _steps(c, posts.least, posts.most)
            rows = np.flatnonzero(last > first)
            share = np.cumsum(last[rows] - first[rows] + 1) // AT_ONCE
            for part in np.split(rows, np.flatnonzero(np.diff(share)) + 1):
                if not len(part):
                    continue
                met, before, point = _first_meetings(c, posts, part, first[part], last[part])
                yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(met)), pa.array(before.astype(np.int32)), *(pa.array(v, from_pandas=True) for v in point.T)], ["_key", "_s0", "x", "y", "z"])


def _met_in_blocks(rows: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """_key, _s0 and point of the first meeting of settled sections; blocks go two sizes on from where they begin."""
    c = F.col
    part = blocks.select(c("tile_id").alias("_tile"), c("brow").alias("_brow"), c("bcol").alias("_bcol"), "width", "height", "gt", "no_data", "block_width", "posts")
    joined = rows.withColumns({"_brow": F.floor(c("_row0") / size).cast("int"), "_bcol": F.floor(c("_col0") / size).cast("int")}).join(part, ["_tile", "_brow", "_bcol"])
    first, left = c("_row0") - c("_brow") * size, c("_col0") - c("_bcol") * size
    posts = F.flatten(F.transform(F.sequence(first, first + c("_row1") - c("_row0")), lambda r: F.slice("posts", r * c("block_width") + left + 1, c("_col1") - c("_col0") + 1)))
    given = joined.select("_key", *CIRCLE, _sign("_side"), "_s0", "_s1", "_h0", "_h1", "_row0", "_row1", "_col0", "_col1", "width", "height", "no_data", *(c("gt")[i].alias(f"_g{i}") for i in range(6)), posts.alias("_posts"))
    met = given.mapInArrow(_walk, f"_key {rows.schema['_key'].dataType.simpleString()}, _s0 int, x double, y double, z double")
    return met.select("_key", "_s0", F.when(c("x").isNotNull(), F.struct("x", "y", "z")).alias("point"))


def _met_between_tiles(rows: DataFrame, blocks: DataFrame, headers: DataFrame, tile: Callable[[Column, Column], Column], size: int) -> DataFrame:
    """The same of single steps, whose ends and meetings ask for their elevations one by one."""
    c = F.col

    def above(df: DataFrame, ends: str, out: str) -> DataFrame:
        """Adds the heights above the terrain."""
        sampled = df
        for e in ends:
            placed = sampled.withColumn("_tile", tile(c(f"_lon{e}"), c(f"_lat{e}")))
            sampled = E.sample(placed, blocks, headers, f"_lon{e}", f"_lat{e}", "_tile", f"_terrain{e}", size)
        # cut before anything asks for the result: conditions on it would carry copies of the whole formula down the plan
        return cut(sampled.withColumns({f"{out}{e}": c(f"_h{e}") - c(f"_terrain{e}") for e in ends}).select(*df.columns, *(f"{out}{e}" for e in ends)))

    rows = above(rows, "01", "_d").where("_d0 is not null and _d1 is not null")
    flat = lambda n: F.abs(c(n)) < sar.ON_SURFACE
    rows = rows.where(flat("_d0") | flat("_d1") | (c("_d0") * c("_d1") < 0))
    first = rows.groupBy("_key").agg(F.min_by(F.struct("_side", *CIRCLE, "_s0", "_s1", "_d0", "_d1"), "_s0").alias("_m")).select("_key", "_m.*")
    first = first.withColumns({"_c0": c("_cb") + c("_s0") * c("_step"), "_c1": c("_cb") + c("_s1") * c("_step"), "_there": F.lit(True)})
    share = F.coalesce(F.try_divide(c("_d0"), c("_d0") - c("_d1")), F.lit(0.0))
    middle = c("_c0") + F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * (c("_c1") - c("_c0"))
    place = F.arrow_udf(_section_place, "_lonm double, _latm double, _hm double")
    for _ in range(ROUNDS):
        first = first.withColumn("_cm", middle)
        first = first.withColumn("_e", place(F.struct(*CIRCLE, _sign("_side"), "_cm"))).select(*first.columns, "_e.*")
        first = above(first, "m", "_d")
        low = F.signum("_dm") == F.signum("_d0")
        # the nearer end is replaced, so the next secant is taken over a shorter stretch
        first = first.withColumns({
            "_c0": F.when(low, c("_cm")).otherwise(c("_c0")), "_d0": F.when(low, c("_dm")).otherwise(c("_d0")), "_c1": F.when(low, c("_c1")).otherwise(c("_cm")), "_d1": F.when(low, c("_d1")).otherwise(c("_dm")),
            "_there": c("_there") & c("_dm").isNotNull(),
        }).drop("_cm", "_lonm", "_latm", "_hm", "_dm")
    met = sar._on_contour(first.withColumn("cos_angle", middle), c("_side"))
    return met.select("_key", "_s0", F.when(c("_there"), c("point")).alias("point"))


def meet_terrain(tracks: DataFrame, row_key: str, side: str, tiles: DataFrame, tile: Callable[[Column, Column], Column], levels: int = 6, size: int = E.BLOCK) -> DataFrame:
    """row_key and struct point where each track first meets the terrain, from below; tracks that meet nothing are absent.

    tracks come from sar.contour_tracks; tiles are elevation tiles, and tile(lon, lat), in degrees, names a place's.  A
    meeting is between two steps with elevation; where it has none itself the track is absent.
    """
    c = F.col
    blocks, headers = E.cut_blocks(tiles, size), tiles.select("tile_id", "width", "height", "gt")
    bounds = cut(height_bounds(blocks, levels))
    left = tracks.select(c(row_key).alias("_key"), c(side).alias("_side"), *CIRCLE, F.lit(0).alias("_s0"), c("_n").alias("_s1"))
    kept, settled = left.columns, None
    for step in SECTIONS:
        starts = F.when(c("_s1") > c("_s0"), F.sequence(c("_s0"), c("_s1") - 1, F.lit(step)))
        rows = left.withColumn("_from", F.explode(starts)).withColumns({"_s1": F.least(c("_from") + step, c("_s1")), "_s0": c("_from")}).drop("_from")
        rows = written(_ruled(_ends(rows, "_side"), bounds, headers, tile, levels, size))
        settled = rows.where("_settled") if settled is None else settled.unionByName(rows.where("_settled"))
        rows = rows.where("not _settled")
        left = rows.select(*kept)
        if done := left.isEmpty():
            break
    met = _met_in_blocks(settled, E.cut_blocks(tiles, size, 2 * size), size)
    if not done:
        met = met.unionByName(_met_between_tiles(rows, blocks, headers, tile, size))
    first = met.groupBy("_key").agg(F.min_by(F.struct("point"), "_s0").alias("_m"))
    return first.where("_m.point is not null").select(c("_key").alias(row_key), "_m.point")


def image_to_tiles(df: DataFrame, params: DataFrame, row_key: str, tiles: DataFrame, tile: Callable[[Column, Column], Column], low: Column, high: Column, key: str = "image_id", x: str = "x", y: str = "y", levels: int = 6) -> DataFrame:
    """row_key, place, lon_deg, lat_deg and height where each pixel's contour first meets the terrain of elevation tiles between two heights."""
    rows = sar.contours(dealt(df), params, key, x, y).withColumns({"_scp": F.col("sar.scp"), "_look": F.col("sar.side")})
    rows = sar.on_height(sar.on_height(rows, "r", "rdot", "arp", "varp", "_scp", F.col("_look"), low, "_low"), "r", "rdot", "arp", "varp", "_scp", F.col("_look"), high, "_high")
    tracks = sar.contour_tracks(rows.select(row_key, "r", "rdot", "arp", "varp", "_low", "_high", "_look"), "r", "rdot", "arp", "varp", "_low", "_high")
    met = meet_terrain(tracks, row_key, "_look", tiles, tile, levels)
    return sar._located(met, [row_key], "point")
