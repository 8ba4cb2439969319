"""Pixels, statistics, elevation, spatial joins, metadata, features and SAR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.functions import radiometry as R
from orbitframe.functions import sar_geometry as S
from orbitframe.functions import text as T
from orbitframe.lineage import dealt
from orbitframe.operators import elevation as E
from orbitframe.operators import features as FE
from orbitframe.operators import sar, spatial, statistics, tiling
from orbitframe.plans.relations import BOXES, PIX, PROBES, PTS, boxes, cut, cut_sql, pix, probes, pts
from orbitframe.sources import des, products, tre

IQ = "SELECT vec_id, CAST(i AS BIGINT) AS k, CAST(embedding[2 * i + 1] AS DOUBLE) AS i, CAST(embedding[2 * i + 2] AS DOUBLE) AS q FROM embeddings, (SELECT unnest(range(32)) AS i)"


def iq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("k"))
    return rows.select("vec_id", F.col("k").cast("long").alias("k"), F.get("embedding", F.col("k") * 2).cast("double").alias("i"), F.get("embedding", F.col("k") * 2 + 1).cast("double").alias("q"))


# Pixels.


def power_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.power(F.col("i"), F.col("q"))
    return iq(spark, sf_dir).select("vec_id", "k", cut(p).alias("power"), cut(R.decibels(F.round(p, 6) + 1), 5).alias("db"))


def amp_phase_lut(spark: SparkSession, sf_dir: str) -> DataFrame:
    lut = F.array(*(F.lit(10.0 + i * i / 64) for i in range(256)))
    z = R.to_complex(F.col("x") % 256, F.col("y") % 256, F.lit("AMP8I_PHS8I"), lut)
    return pix(spark, sf_dir).select("x", "y").distinct().select("x", "y", cut(z["i"], 5).alias("i"), cut(z["q"], 5).alias("q"))


def _stretched(how: str, digits: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = statistics.stretched(iq(spark, sf_dir).select("vec_id", "k", R.power(F.col("i"), F.col("q")).alias("v")), ["vec_id"], how=how)
        return got.select("vec_id", "k", cut(F.col("display"), digits).alias("display"))

    return run


def minmax_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = statistics.stretched(pix(spark, sf_dir), ["image", "band"], how="minmax")
    return got.groupBy("image", "band", "display").agg(F.count("*").alias("n"))


def dra_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = pix(spark, sf_dir).groupBy("image", F.col("v").cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return statistics.dra_parameters(counts, ["image"], 256).select("image", cut(F.col("lo"), 4).alias("lo"), cut(F.col("hi"), 4).alias("hi"), "actual_lo", "actual_hi")


def dra_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pix(spark, sf_dir)
    counts = rows.groupBy("image", F.col("v").cast("int").alias("bin")).agg(F.count("*").alias("n"))
    p = statistics.dra_parameters(counts, ["image"], 256, max_share=0.97)
    return rows.join(p, "image").groupBy("image", R.dra_byte(F.col("v"), F.col("lo"), F.col("hi")).alias("display")).agg(F.count("*").alias("n"))


def _dra_sql(share: float) -> str:
    return f"""(WITH h AS (SELECT image, CAST(v AS INTEGER) AS bin, count(*) AS n FROM ({PIX}) GROUP BY 1, 2),
full_h AS (SELECT i.image, b.bin, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT image FROM h) i CROSS JOIN (SELECT unnest(range(256))::INTEGER AS bin) b LEFT JOIN h ON h.image = i.image AND h.bin = b.bin),
c AS (SELECT *, sum(n) OVER (PARTITION BY image ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY image) AS whole FROM full_h),
e AS (SELECT image, min(bin) FILTER (WHERE upto >= 0.02 * whole) AS e_min, coalesce(max(bin) FILTER (WHERE upto <= {share} * whole), 0) AS e_max, min(bin) FILTER (WHERE n > 0) AS actual_lo, max(bin) FILTER (WHERE n > 0) AS actual_hi FROM c GROUP BY image)
SELECT image, greatest(actual_lo::DOUBLE, e_min - 0.2::DOUBLE * (e_max - e_min)) AS lo, least(actual_hi::DOUBLE, e_max + 0.4::DOUBLE * (e_max - e_min)) AS hi, actual_lo, actual_hi FROM e)"""


def band_stats_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = statistics.band_scales(pix(spark, sf_dir), ["band"], "Byte", "MINMAX", 250)
    return got.select("band", cut(F.col("src_lo"), 5).alias("src_lo"), cut(F.col("src_hi"), 5).alias("src_hi"), "dst_lo", "dst_hi")


def sar_band_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pix(spark, sf_dir).where(F.col("band") <= 2)
    return statistics.sar_precomputed_mean(rows, ["image"]).select("image", cut(F.col("mean"), 4).alias("mean"))


def pixel_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orbitframe.sources.rasters import window

    rows = pix(spark, sf_dir).withColumn("r_level", F.lit(0))
    return window(rows, 100, 50, 128, 64, 0, [1, 2]).groupBy("image", "band").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


# Elevation.


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-degree tiles of 41 x 41 posts keyed by a running number; some posts have no data."""
    k = F.col("n_nationkey")
    tiles = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("t"), k.cast("string")).alias("tile_id"), F.lit(41).alias("width"), F.lit(41).alias("height"), F.array(-180.0 + k * 10.0, F.lit(0.25), F.lit(0.0), F.lit(5.0), F.lit(0.0), F.lit(-0.25)).alias("gt"), k)
    z = F.transform(F.sequence(F.lit(0), F.lit(1680)), lambda p: F.when((p * 7 + k) % 97 == 0, F.lit(-9999.0)).otherwise(((p * 13 + k * 29) % 500).cast("double")))
    return tiles.select("tile_id", "width", "height", "gt", z.alias("z"), F.lit(-9999.0).alias("no_data"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pts(spark, sf_dir).withColumn("lat_deg", F.col("lat_deg") / 16)
    return rows.withColumn("tile_id", F.concat(F.lit("t"), F.floor((F.col("lon_deg") + 180) / 10).cast("string")))


def dem_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = dem(spark, sf_dir)
    got = E.set_elevation(E.sample(_placed(spark, sf_dir), E.cut_blocks(tiles), tiles), F.col("sampled"))
    return got.select("o_orderkey", cut(F.col("elev"), 4).alias("elev"), "found")


def dem_provider_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = dem(spark, sf_dir)
    got = E.sample(_placed(spark, sf_dir), E.cut_blocks(tiles), tiles)
    north = E.when(F.col("lat_deg") > 0, E.plus(F.col("sampled"), F.lit(100.0)))
    return got.select("o_orderkey", cut(E.first_of(north, F.col("sampled"), F.lit(-1.0)), 4).alias("elev"))


_POST = "CASE WHEN (({r} * 41 + {c}) * 7 + t) % 97 = 0 THEN NULL ELSE ((({r} * 41 + {c}) * 13 + t * 29) % 500)::DOUBLE END"
_DEM = f"""(SELECT o_orderkey, elev, lat_deg, CASE WHEN t < 25 THEN CASE WHEN fy = 0 THEN top WHEN fy = 1 THEN bottom ELSE top * (1 - fy) + bottom * fy END END AS sampled FROM (
SELECT *, CASE WHEN fx = 0 THEN z00 WHEN fx = 1 THEN z01 ELSE z00 * (1 - fx) + z01 * fx END AS top, CASE WHEN fx = 0 THEN z10 WHEN fx = 1 THEN z11 ELSE z10 * (1 - fx) + z11 * fx END AS bottom FROM (
SELECT *, x - c AS fx, y - r AS fy, {_POST.format(r="r", c="c")} AS z00, {_POST.format(r="r", c="(c + 1)")} AS z01, {_POST.format(r="(r + 1)", c="c")} AS z10, {_POST.format(r="(r + 1)", c="(c + 1)")} AS z11 FROM (
SELECT *, CAST(least(floor(x), 39) AS BIGINT) AS c, CAST(least(floor(y), 39) AS BIGINT) AS r FROM (
SELECT *, greatest(0, least((lon_deg - (-180 + t * 10)) / 0.25::DOUBLE, 40)) AS x, greatest(0, least((lat_deg - 5) / -0.25::DOUBLE, 40)) AS y FROM (
SELECT o_orderkey, elev, lon_deg, lat_deg / 16 AS lat_deg, CAST(floor((lon_deg + 180) / 10) AS BIGINT) AS t FROM ({PTS})))))))"""


def region_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = E.summaries(dem(spark, sf_dir))
    return got.select("tile_id", "min_z", "max_z", "no_data", (F.col("post_spacing") > 0).alias("spaced"))


def offset_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A world grid of offsets, one tile of 37 x 19 posts at ten degrees."""
    z = F.transform(F.sequence(F.lit(0), F.lit(37 * 19 - 1)), lambda p: ((p * 17) % 101).cast("double"))
    grid = spark.range(1).select(F.lit("w").alias("tile_id"), F.lit(37).alias("width"), F.lit(19).alias("height"), F.array(*(F.lit(v) for v in (-180.0, 10.0, 0.0, 90.0, 0.0, -10.0))).alias("gt"), z.alias("z"), F.lit(-9999.0).alias("no_data"))
    got = E.sample(pts(spark, sf_dir).withColumn("tile_id", F.lit("w")), E.cut_blocks(grid), grid)
    return got.select("o_orderkey", cut(E.plus(F.col("elev"), E.checked(F.col("lon_deg"), F.col("lat_deg"), F.col("sampled"))), 4).alias("elev"))


def offset_grid_flipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets in half metres, with both axes running backwards, at places a whole turn further east."""
    z = F.transform(F.sequence(F.lit(0), F.lit(36 * 18 - 1)), lambda p: ((p * 17) % 101).cast("double"))
    grid = spark.range(1).select(F.lit("w").alias("tile_id"), F.lit(36).alias("width"), F.lit(18).alias("height"), F.array(*(F.lit(v) for v in (180.0, -10.0, 0.0, -90.0, 0.0, 10.0))).alias("gt"), z.alias("z"), F.lit(-9999.0).alias("no_data"))
    grid = E.offset_tiles(grid, 0.5)
    rows = pts(spark, sf_dir).withColumns({"tile_id": F.lit("w"), "lon_deg": F.col("lon_deg") + 360})
    got = E.at_normalized(rows, lambda df: E.sample(df, E.cut_blocks(grid), grid, "norm_lon_deg", "norm_lat_deg"))
    return got.select("o_orderkey", cut(F.col("lon_deg"), 3).alias("lon"), cut(E.plus(F.col("elev"), F.col("sampled")) + 1.3e-6, 4).alias("elev"))


_FLIPPED_POST = "(((({r}) * 36 + ({c})) * 17) % 101) * 0.5::DOUBLE"
_FLIPPED = f"""SELECT o_orderkey, {cut_sql('lon_deg + 360', 3)} AS lon, {cut_sql(f"elev + ({_FLIPPED_POST.format(r='r', c='c')} * (1 - x + c) + {_FLIPPED_POST.format(r='r', c='c + 1')} * (x - c)) * (1 - y + r) + ({_FLIPPED_POST.format(r='r + 1', c='c')} * (1 - x + c) + {_FLIPPED_POST.format(r='r + 1', c='c + 1')} * (x - c)) * (y - r) + 1.3e-6::DOUBLE", 4)} AS elev FROM (
SELECT *, CAST(least(floor(x), 34) AS BIGINT) AS c, CAST(least(floor(y), 16) AS BIGINT) AS r FROM (SELECT o_orderkey, elev, lon_deg, greatest(0, least((lon_deg - 175) / -10, 35)) AS x, greatest(0, least((lat_deg + 85) / 10, 17)) AS y FROM ({PTS})))"""

_OFF = "(((({r}) * 37 + ({c})) * 17) % 101)::DOUBLE"
_OFFSET = f"""SELECT o_orderkey, {cut_sql(f"elev + ({_OFF.format(r='r', c='c')} * (1 - x + c) + {_OFF.format(r='r', c='c + 1')} * (x - c)) * (1 - y + r) + ({_OFF.format(r='r + 1', c='c')} * (1 - x + c) + {_OFF.format(r='r + 1', c='c + 1')} * (x - c)) * (y - r)", 4)} AS elev FROM (
SELECT *, CAST(least(floor(x), 35) AS BIGINT) AS c, CAST(least(floor(y), 17) AS BIGINT) AS r FROM (SELECT o_orderkey, elev, (lon_deg + 180) / 10 AS x, (lat_deg - 90) / -10 AS y FROM ({PTS})))"""


# Spatial joins.


def find_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.find_intersects(boxes(spark, sf_dir), probes(spark, sf_dir), 64.0).select("q_s_suppkey", "f_c_custkey")


def find_nearest_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.find_nearest(boxes(spark, sf_dir), probes(spark, sf_dir), "s_suppkey", 80.0).select("q_s_suppkey", "f_c_custkey", cut(F.col("distance")).alias("distance"))


def _polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diamond with a square hole around a place of each supplier, whose rings are relative to that place."""
    k = F.col("s_suppkey")
    x, y = (k * 37 % 340 - 170).cast("double"), (k * 53 % 150 - 75).cast("double")
    ring = lambda places: F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in places))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("geom_id"), F.struct(x.alias("x"), y.alias("y")).alias("origin"), F.array(ring(DIAMOND), ring(HOLE)).alias("rings"))


def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.find_polygon(pts(spark, sf_dir), _polygons(spark, sf_dir), "lon_deg", "lat_deg", "o_orderkey").select("o_orderkey", "geom_id")


def semi_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.covered(pts(spark, sf_dir), _polygons(spark, sf_dir), "lon_deg", "lat_deg").select("o_orderkey")


def anti_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.covered(pts(spark, sf_dir), _polygons(spark, sf_dir), "lon_deg", "lat_deg", invert=True).select("o_orderkey")


#: A supplier's polygon around its place, and the hole in it.
DIAMOND = [(-3.3, 0.05), (0.05, 4.3), (3.3, 0.05), (0.05, -4.3), (-3.3, 0.05)]
HOLE = [(-1.1, -1.1), (1.1, -1.1), (1.1, 1.1), (-1.1, 1.1), (-1.1, -1.1)]


def inside_sql() -> str:
    cross = lambda ax, ay, bx, by: f"(({ay} > lat_deg - y) <> ({by} > lat_deg - y) AND lon_deg - x < {ax} + ({bx} - {ax}) * (lat_deg - y - {ay}) / nullif({by} - {ay}, 0))"
    sides = lambda p: " + ".join(f"CASE WHEN coalesce({cross(*(f'({v}::DOUBLE)' for v in (*a, *b)))}, false) THEN 1 ELSE 0 END" for a, b in zip(p, p[1:], strict=False))
    outer = sides(DIAMOND)
    hole = sides(HOLE)
    return f"SELECT o_orderkey, geom_id FROM ({PTS}) p JOIN (SELECT s_suppkey AS geom_id, (s_suppkey * 37 % 340 - 170)::DOUBLE AS x, (s_suppkey * 53 % 150 - 75)::DOUBLE AS y FROM supplier) g ON abs(lon_deg - x) < 5 AND abs(lat_deg - y) < 5 WHERE (({outer}) % 2 + ({hole}) % 2) % 2 = 1"


def ortho_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen tiles of 32 x 32 pixels over a plate; the source is a mosaic of means."""
    source = pix(spark, sf_dir).groupBy("image", (F.col("x") % 48).alias("x"), (F.col("y") % 48).alias("y")).agg(F.avg("v").alias("v"))
    k = F.col("id")
    tiles = spark.range(16).select(k.alias("tile"), (k % 8).alias("image"), (k * 0.25).alias("west"), (k * 0.25 + 40).alias("east"), F.lit(0.0).alias("south"), F.lit(64.0).alias("north"))
    got = tiling.orthophoto(tiles, source, "image", ["tile"], lambda lon, lat: (lon * 0.9, lat * 0.7), 32)
    return got.select("tile", "x", "y", cut(F.col("v") + 1.3e-6, 4).alias("v"))


_ORTHO = f"""WITH s AS (SELECT image, x % 48 AS x, y % 48 AS y, avg(v) AS v FROM ({PIX}) GROUP BY 1, 2, 3),
g AS (SELECT t.tile, t.tile % 8 AS image, a.x, b.y, (t.tile * 0.25::DOUBLE + (a.x + 0.5::DOUBLE) / 32 * 40) * 0.9::DOUBLE AS sx, (64 - (b.y + 0.5::DOUBLE) / 32 * 64) * 0.7::DOUBLE AS sy FROM (SELECT unnest(range(16)) AS tile) t CROSS JOIN (SELECT unnest(range(32)) AS x) a CROSS JOIN (SELECT unnest(range(32)) AS y) b),
k AS (SELECT g.*, dx, dy, floor(sx) + dx AS px, floor(sy) + dy AS py, (CASE dx WHEN 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END) * (CASE dy WHEN 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END) AS w FROM g CROSS JOIN (SELECT unnest([0, 1]) AS dx) CROSS JOIN (SELECT unnest([0, 1]) AS dy))
SELECT k.tile, CAST(k.x AS INTEGER) AS x, CAST(k.y AS INTEGER) AS y, {cut_sql("sum(w * s.v) + 1.3e-6::DOUBLE", 4)} AS v FROM k JOIN s ON s.image = k.image AND s.x = k.px AND s.y = k.py GROUP BY 1, 2, 3 HAVING count(*) = 4"""


# Metadata.


def _tre_xml() -> Column:
    text = lambda n, v: F.concat(F.lit(f'<field name="{n}" value="'), v.cast("string"), F.lit('" />'))
    group = lambda i, v: F.concat(F.lit(f'<group index="{i}"><field name="C" value="'), v.cast("string"), F.lit('" /></group>'))
    coefs = F.concat(F.lit('<repeated name="LINE_NUM_COEFF" number="20">'), group(3, F.concat(F.lit("+"), F.col("p_size"))), group(0, F.col("p_partkey") % 7), group(19, F.lit("-1.5E+0")), F.lit("</repeated>"))
    return F.concat(F.lit('<?xml version="1.0"?><tres><tre name="RPC00B">'), text("SUCCESS", F.col("p_partkey") % 2), text("LAT_OFF", F.concat(F.lit("+"), F.col("p_size"), F.lit(".25"))), text("LINE_OFF", F.col("p_partkey")), coefs, F.lit("</tre></tres>"))


def tre_field_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")).select("p_partkey", _tre_xml().alias("xml"))
    f = F.col("f")
    rows = rows.withColumn("f", tre.record(F.col("xml"), "RPC00B"))
    # the values are read before rows are left out, so that the record is parsed once
    rows = rows.select("p_partkey", tre.value_of(f, "SUCCESS", "int").alias("good"), tre.value_of(f, "LAT_OFF", "double").alias("lat_off"), tre.value_of(f, "LINE_OFF", "long").alias("line_off"), tre.value_of(f, "NONE", "double").alias("missing"))
    return rows.select("p_partkey", F.inline_outer(F.when(F.col("good") == 1, F.array(F.struct("lat_off", "line_off", "missing"))))).where("line_off is not null")


def rpc_coeff_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")).select("p_partkey", tre.coefficients(_tre_xml(), "RPC00B", "LINE_NUM_COEFF").alias("c"))
    return rows.select("p_partkey", F.size("c").alias("n"), F.col("c")[0].alias("c0"), F.col("c")[1].alias("c1"), F.col("c")[3].alias("c3"), F.col("c")[19].alias("c19"))


def des_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of nested XML: their header, and the text they carry in base64."""
    field = lambda n, v: F.concat(F.lit(f'<field name="{n}" value="'), v, F.lit('" />'))
    values = {n: F.lit("") for n, _ in T.DES_FIELDS} | {"DESVER": F.lit("1"), "DECLAS": F.lit("U"), "DESCODE": F.col("p_brand"), "DESCTLN": F.col("p_partkey").cast("string"), "DESSHL": F.lit("5"), "DESSHF": F.lit("abc"), "DESDATA": F.base64(F.col("p_name").cast("binary"))}
    xml = F.concat(F.lit('<?xml version="1.0"?><des_list><des name="XML_DATA_CONTENT">'), *(field(n, v) for n, v in values.items()), F.lit("</des></des_list>"))
    rows = dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_name")).select(F.col("p_partkey").alias("image_id"), xml.alias("xml"))
    found = des.by_name(des.segments(rows), "XML_DATA_CONTENT")
    return found.select(F.col("image_id").alias("p_partkey"), T.des_header(F.col("fields")).alias("header"), des.data_xml(F.col("fields"), F.col("segment")).alias("data"))


def _des_sql() -> str:
    value = {"DECLAS": "'U'", "DESCODE": "p_brand", "DESCTLN": "CAST(p_partkey AS VARCHAR)"}
    cells = " || ".join(f"CASE WHEN length({value.get(n, chr(39) * 2)}) < {w} THEN lpad({value.get(n, chr(39) * 2)}, {w}, ' ') ELSE {value.get(n, chr(39) * 2)} END" for n, w in T.DES_FIELDS)
    return f"SELECT p_partkey, '01' || {cells} || '0005' || '  abc' AS header, p_name AS data FROM part"


def extension_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(n) for n in ("ntf", "nitf", "tif", "tiff", "jpg", "jpeg", "png", "h5")))
    k = F.col("p_partkey")
    path = F.concat(F.lit("/data/"), F.col("p_brand"), F.lit("."), names[(k % 8).cast("int")])
    options = F.array(names[((k + 3) % 8).cast("int")], names[(k % 8).cast("int")])
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.image_extension(path, options).alias("extension"), T.normalize_extension(names[(k % 8).cast("int")]).alias("plain"))


def compression_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda vs, by: F.array(*(F.lit(v) for v in vs))[(F.floor(F.col("p_partkey") / by) % len(vs)).cast("int")]
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", pick(("NITF", "GTiff", "PNG", "JPEG"), 1).alias("f"), pick((None, "NONE", "JPEG", "J2K", "LZW"), 4).alias("c"), (F.floor(F.col("p_partkey") / 20) % 2 == 1).alias("fl"))
    return rows.select("p_partkey", T.creation_option(F.col("f"), F.col("c"), F.col("fl")).alias("option"))


# Features.


def _props() -> Column:
    e = F.col("event_id")
    x, y = (e * 13 % 900).cast("string"), (e * 29 % 700).cast("string")
    x1, y1 = (e * 13 % 900 + 10).cast("string"), (e * 29 % 700 + 20).cast("string")
    box = F.concat(F.lit("["), x, F.lit(","), y, F.lit(","), x1, F.lit(","), y1, F.lit("]"))
    pair = F.concat(F.lit("["), x, F.lit(","), y, F.lit("]"))
    old = F.concat(F.lit('"bounds_imcoords":'), box)
    return F.when(e % 5 == 0, F.concat(F.lit('{"imageGeometry":{"type":"Point","coordinates":'), pair, F.lit("},"), old, F.lit("}"))).when(e % 5 == 1, F.concat(F.lit('{"imageBBox":'), box, F.lit("}"))).when(e % 5 == 2, F.concat(F.lit('{"detection":{"type":"Point","pixelCoordinates":'), pair, F.lit("},"), old, F.lit("}"))).when(e % 5 == 3, F.concat(F.lit("{"), old, F.lit("}"))).otherwise(F.lit('{"other":1}'))


def geojson_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = FE.find_image_geometry(F.col("p"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", _props().alias("p")).select("event_id", g.alias("g"))
    return rows.select("event_id", F.col("g")["source"].alias("source"), F.col("g")["type"].alias("type"))


def geometry_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", _props().alias("p"))
    b = FE.bounds(FE.vertices(FE.find_image_geometry(F.col("p"))))
    return rows.select("event_id", b.alias("b")).where(F.col("b").isNotNull()).select("event_id", *(F.col("b")[i].alias(n) for i, n in enumerate(spatial.BOX)))


def geolocate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of 40 images located by their grids of a plane model, which interpolation gives back exactly."""
    rows = boxes(spark, sf_dir).withColumn("image", F.col("c_custkey") % 40)
    grid = FE.control_grid(rows, "image").withColumns({"lon": F.radians(F.col("x") * 0.01 - 20), "lat": F.radians(30 - F.col("y") * 0.005)})
    got = FE.geolocated_boxes(rows, grid, "image", "c_custkey")
    return got.select("c_custkey", *(cut(F.col(n)).alias(n) for n in ("min_lon", "max_lon", "min_lat", "max_lat", "center_longitude", "center_latitude")))


def geolocate_geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, lines and polygons with a hole, of 40 images, located by the grids of a plane model."""
    e = F.col("event_id")
    x, y = (e * 13 % 900).cast("double"), (e * 29 % 700).cast("double")
    at = lambda dx, dy: F.concat(F.lit("["), (x + dx).cast("string"), F.lit(", "), (y + dy).cast("string"), F.lit("]"))
    ring = lambda *p: F.concat(F.lit("["), F.concat_ws(",", *(at(*q) for q in p)), F.lit("]"))
    shape = F.when(e % 3 == 0, at(0, 0)).when(e % 3 == 1, ring((0, 0), (9, 4), (20, 1))).otherwise(F.concat(F.lit("["), ring((0, 0), (20, 0), (20, 10), (0, 0)), F.lit(","), ring((15, 2), (17, 2), (17, 3), (15, 2)), F.lit("]")))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (e % 40).alias("image"), shape.alias("coordinates"), x.alias("xmin"), y.alias("ymin"), (x + 20).alias("xmax"), (y + 10).alias("ymax"))
    grid = FE.control_grid(rows, "image").withColumns({"lon": F.radians(F.col("x") * 0.01 - 20), "lat": F.radians(30 - F.col("y") * 0.005)})
    got = FE.geolocated_geometries(rows.select("event_id", "image", "coordinates"), grid, "image")
    shell = F.regexp_replace("world_coordinates", "[^\\[\\]]", "")
    got = got.select("event_id", shell.alias("shape"), FE.vertices(F.struct(F.col("world_coordinates").alias("coordinates"))).alias("p"))
    return got.select("event_id", "shape", F.size("p").alias("n"), *(cut(F.element_at("p", i)[k], 5).alias(f"{a}_{w}") for i, w in ((1, "first"), (-1, "last")) for k, a in ((0, "lon"), (1, "lat"))))


def display_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of seven bands show three, and those of two their quarter power."""
    rows = pix(spark, sf_dir).where("image % 2 = 0 or band <= 2")
    rows = rows.groupBy("image", "band", (F.col("x") % 32).alias("x"), (F.col("y") % 32).alias("y")).agg(F.max("v").alias("v"))
    got = statistics.displayed(rows)
    return got.select("image", F.size("bands").alias("n"), F.col("bands")[0].alias("one"), F.get("bands", F.lit(2)).alias("three")).groupBy("image", "n").agg(F.count("*").alias("pixels"), F.sum("one").alias("one"), F.sum("three").alias("three"))


# SAR.

#: A fixed straight pass at 7 km/s, seen from 700 km.
SCP = (6378137.0, 0.0, 0.0)
ARP = ((6878137.0, 0.0), (-100.0, 7000.0), (490000.0, 20.0))
U_ROW, U_COL = (-0.6, 0.0, 0.8), (0.0, 1.0, 0.0)


def _arp() -> tuple[Column, Column, Column]:
    return tuple(F.array(*(F.lit(v) for v in c)) for c in ARP)


def _sar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the image plane, with time, position and velocity."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") * 7919 % 2000 - 1000).cast("double").alias("rg"), (F.col("o_custkey") * 3571 % 1600 - 800).cast("double").alias("az"))
    rows = rows.withColumn("t", 0.01 + F.col("az") * 1e-5)
    arp, varp = S.state(_arp(), F.col("t"))
    rows, at = S.spread(rows, arp=arp, varp=varp)
    return rows.withColumns({n: S.packed(v) for n, v in at.items()})


_SAR = "(SELECT o_orderkey, rg, az, t, 6878137.0::DOUBLE AS px, -100 + 7000 * t AS py, 490000 + 20 * t AS pz, 0.0::DOUBLE AS vx, 7000.0::DOUBLE AS vy, 20.0::DOUBLE AS vz FROM (SELECT *, 0.01::DOUBLE + az * 1e-5 AS t FROM (SELECT o_orderkey, ((o_orderkey * 7919) % 2000 - 1000)::DOUBLE AS rg, ((o_custkey * 3571) % 1600 - 800)::DOUBLE AS az FROM orders)))"
_TO_SCP = f"(SELECT *, sqrt((px - 6378137.0) * (px - 6378137.0) + py * py + pz * pz) AS r0, (vy * py + vz * pz) / sqrt((px - 6378137.0) * (px - 6378137.0) + py * py + pz * pz) AS d0 FROM {_SAR})"


def _contour(rows: DataFrame, pair: tuple[Column, Column]) -> DataFrame:
    return rows.select("o_orderkey", cut(pair[0], 3).alias("r"), cut(pair[1], 5).alias("rdot"))


def sar_pfa_rrdot(spark: SparkSession, sf_dir: str) -> DataFrame:
    polar, factor = F.array(F.lit(0.0), F.lit(0.01)), F.array(F.lit(1.0), F.lit(0.002))
    return _contour(_sar(spark, sf_dir), S.polar_format(F.col("rg"), F.col("az"), F.col("t"), S.unpacked(F.col("arp")), S.unpacked(F.col("varp")), S.literal(SCP), polar, factor))


def sar_rgazcomp_rrdot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contour(_sar(spark, sf_dir), S.range_azimuth_compressed(F.col("rg"), F.col("az"), S.unpacked(F.col("arp")), S.unpacked(F.col("varp")), S.literal(SCP), F.lit(1e-6)))


def sar_inca_rrdot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.array(F.array(F.lit(1.0), F.lit(1e-7)), F.array(F.lit(2e-7), F.lit(0.0)))
    return _contour(_sar(spark, sf_dir), S.imaging_near_closest_approach(F.col("rg"), F.col("az"), F.col("t"), _arp(), F.lit(700071.0), F.array(F.lit(0.005), F.lit(1.2e-5)), rate))


def sar_plane_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contours of a uniform plane on the ground plane at the centre point."""
    rows = _sar(spark, sf_dir)
    arp, varp, scp = S.unpacked(F.col("arp")), S.unpacked(F.col("varp")), S.literal(SCP)
    r, rdot = S.uniform_plane(F.col("rg"), F.col("az"), arp, varp, scp, S.literal(U_ROW), S.literal(U_COL))
    rows = rows.withColumns({"r": r, "rdot": rdot})
    rows = sar.on_plane(rows, "r", "rdot", "arp", "varp", S.packed(scp), S.packed(S.literal((1.0, 0.0, 0.0))), "p")
    return rows.select("o_orderkey", cut(F.col("r"), 3).alias("r"), cut(F.col("rdot"), 5).alias("rdot"), cut(F.col("p")["y"], 2).alias("y"), cut(F.col("p")["z"], 2).alias("z"))


def sar_height_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contours on a constant height: all results lie on that height, at their range, range rate and side of the track."""
    from orbitframe.functions import geodesy as G

    rows = _sar(spark, sf_dir).withColumn("scp", S.packed(S.literal(SCP)))
    arp, varp, scp = S.unpacked(F.col("arp")), S.unpacked(F.col("varp")), S.literal(SCP)
    r, rdot = S.uniform_plane(F.col("rg"), F.col("az"), arp, varp, scp, S.literal(U_ROW), S.literal(U_COL))
    rows = sar.on_height(rows.withColumns({"r": r, "rdot": rdot}), "r", "rdot", "arp", "varp", "scp", F.lit("R"), F.lit(100.0), "p")
    p = S.unpacked(F.col("p"))
    d = S.sub(arp, p)
    return rows.select("o_orderkey", cut(G.ecef_to_geodetic(*p)[2], 3).alias("hae"), (F.abs(S.norm(d) - F.col("r")) < 0.5).alias("in_range"), (F.abs(S.dot(varp, d) / S.norm(d) - F.col("rdot")) < 0.05).alias("in_rate"), S.side_of_track(p, arp, varp).alias("side"))


def contour_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign changes of an event value along each user's events."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id"), F.col("event_id").alias("step"), (F.col("value") - 50.0).alias("delta"))
    got = sar.crossings(rows, "user_id", "delta")
    return got.select("user_id", "step", cut(F.col("fraction")).alias("fraction"))


def sidd_bilinear_chip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chip of a chip: corners in the original image."""
    k = F.col("o_orderkey")
    old = F.struct(F.lit(512.0).alias("rows"), F.lit(512.0).alias("cols"), F.array(*(F.struct(F.lit(float(c)).alias("col"), F.lit(float(r)).alias("row")) for c, r in ((7407, 7408), (7919, 7408), (7919, 7920), (7407, 7920)))).alias("corners"))
    chip = tiling.sidd_chip(k % 100, k % 70, F.lit(64), F.lit(32), F.when(k % 3 > 0, old))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", chip.alias("c"))
    return rows.select("o_orderkey", *(cut(F.col("c")["corners"][i][n], 4).alias(f"{n}{i}") for i in range(4) for n in ("col", "row")))


def _sidd_sql() -> str:
    cells = []
    for i, (dx, dy) in enumerate([(0, 0), (63, 0), (63, 31), (0, 31)]):
        x, y = f"(o_orderkey % 100 + {dx})", f"(o_orderkey % 70 + {dy})"
        for n, v in (("col", x), ("row", y)):
            base = 7407 if n == "col" else 7408
            cells.append(f"{cut_sql(f'CASE WHEN o_orderkey % 3 > 0 THEN {base} + {v} / 511.0::DOUBLE * 512 ELSE {v} END', 4)} AS {n}{i}")
    return f"SELECT o_orderkey, {', '.join(cells)} FROM orders"


_V2 = "(7000.0::DOUBLE * 7000 + 400)"
_INCA = f"(SELECT *, sqrt((700071.0::DOUBLE + rg) * (700071.0::DOUBLE + rg) + f * {_V2} * dt * dt) AS r FROM (SELECT *, t - (0.005::DOUBLE + 1.2e-5 * az) AS dt, 1 + 1e-7 * az + 2e-7 * rg AS f FROM {_SAR}))"
_UNI = f"(SELECT *, sqrt(lx * lx + ly * ly + lz * lz) AS r, (vy * ly + vz * lz) / sqrt(lx * lx + ly * ly + lz * lz) AS rdot FROM (SELECT *, px - (6378137.0 - 0.6::DOUBLE * rg) AS lx, py - az AS ly, pz - 0.8::DOUBLE * rg AS lz FROM {_SAR}))"
# with the plane x = 6378137 the nadir distance is 500000, the velocity lies in the plane
_PLANE = f"SELECT o_orderkey, {cut_sql('r', 3)} AS r, {cut_sql('rdot', 5)} AS rdot, {cut_sql('py + g * (c * uy - s * uz)', 2)} AS y, {cut_sql('pz + g * (c * uz + s * uy)', 2)} AS z FROM (SELECT *, -rdot / (v * g / r) AS c, sign(py * vz - pz * vy) * sqrt(1 - (rdot / (v * g / r)) * (rdot / (v * g / r))) AS s FROM (SELECT *, sqrt(r * r - 250000000000.0::DOUBLE) AS g, sqrt(vy * vy + vz * vz) AS v, vy / sqrt(vy * vy + vz * vz) AS uy, vz / sqrt(vy * vy + vz * vz) AS uz FROM {_UNI}))"
_POWER = f"SELECT vec_id, k, i * i + q * q AS v FROM ({IQ})"
_STRETCH = "SELECT vec_id, k, {0} AS display FROM (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi, avg(v) OVER w AS mean, avg(sqrt(v)) OVER w AS root FROM ({1}) WINDOW w AS (PARTITION BY vec_id))"
_GEO = "CASE event_id % 5 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} END"

QUERIES = {
    "linear_mapping": _stretched("linear", 6), "histogram_stretch": _stretched("histogram", 4), "quarter_power": _stretched("quarter", 4),
} | {
    f.__name__: f
    for f in (
        power_db, amp_phase_lut, minmax_stretch, dra_params, dra_stretch, band_stats_scales, sar_band_mean, pixel_window, dem_bilinear, dem_provider_chain, region_summary, offset_grid, offset_grid_flipped, find_intersects, find_nearest_ties,
        point_in_polygon, semi_intersects, anti_intersects, ortho_resample, tre_field_extract, rpc_coeff_dense, des_header, extension_normalize, compression_matrix, geojson_precedence, geometry_bounds, geolocate_grid, geolocate_geometries, display_bands,
        sar_pfa_rrdot, sar_rgazcomp_rrdot, sar_inca_rrdot, sar_plane_project, sar_height_project, contour_crossings, sidd_bilinear_chip,
    )
}

ORACLES = {
    "power_db": f"SELECT vec_id, k, {cut_sql('v')} AS power, {cut_sql('10 * log10(round(v, 6) + 1)', 5)} AS db FROM ({_POWER})",
    "amp_phase_lut": f"SELECT x, y, {cut_sql('a * cos(p)', 5)} AS i, {cut_sql('a * sin(p)', 5)} AS q FROM (SELECT DISTINCT x, y, 10 + (x % 256) * (x % 256) / 64.0::DOUBLE AS a, (y % 256) * (2 * pi() / 256) AS p FROM ({PIX}))",
    "linear_mapping": _STRETCH.format(cut_sql("CASE WHEN hi = lo THEN 0.5 ELSE greatest(0, least(1, (v - lo) / (hi - lo))) END"), _POWER),
    "histogram_stretch": _STRETCH.format(cut_sql("greatest(0, least(255, 255 * v / (8 * mean)))", 4), _POWER),
    "quarter_power": _STRETCH.format(cut_sql("greatest(0, least(255, 255 * sqrt(v) / (3 * root)))", 4), _POWER),
    "minmax_stretch": f"SELECT image, band, CAST(floor(greatest(0, least(255, (v - lo) * (255.0::DOUBLE / greatest(hi, 1))))) AS INTEGER) AS display, count(*) AS n FROM (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM ({PIX}) WINDOW w AS (PARTITION BY image, band)) GROUP BY 1, 2, 3",
    "dra_params": f"SELECT image, {cut_sql('lo', 4)} AS lo, {cut_sql('hi', 4)} AS hi, actual_lo, actual_hi FROM {_dra_sql(0.98)}",
    "dra_stretch": f"SELECT image, CAST(floor(greatest(0, least(255, 255 * (v - lo) / greatest(hi - lo, 1)))) AS INTEGER) AS display, count(*) AS n FROM ({PIX}) JOIN {_dra_sql(0.97)} USING (image) GROUP BY 1, 2",
    "band_stats_scales": f"SELECT band, {cut_sql('lo', 5)} AS src_lo, {cut_sql('lo + 249 * (hi - lo) / 250', 5)} AS src_hi, 0.0::DOUBLE AS dst_lo, 255.0::DOUBLE AS dst_hi FROM (SELECT band, min(v) AS lo, max(v) AS hi FROM ({PIX}) GROUP BY band)",
    "sar_band_mean": f"SELECT image, {cut_sql('sqrt(sum(m * m))', 4)} AS mean FROM (SELECT image, band, avg(v) + stddev_pop(v) * (50.0::DOUBLE / 68) AS m FROM ({PIX}) WHERE band <= 2 GROUP BY 1, 2) GROUP BY image",
    "pixel_window": f"SELECT image, band, count(*) AS n, sum(v) AS total FROM ({PIX}) WHERE x BETWEEN 100 AND 227 AND y BETWEEN 50 AND 113 AND band IN (1, 2) GROUP BY 1, 2",
    "dem_bilinear": f"SELECT o_orderkey, {cut_sql('coalesce(sampled, elev)', 4)} AS elev, sampled IS NOT NULL AS found FROM {_DEM}",
    "dem_provider_chain": f"SELECT o_orderkey, {cut_sql('coalesce(CASE WHEN lat_deg > 0 THEN sampled + 100 END, sampled, -1)', 4)} AS elev FROM {_DEM}",
    "region_summary": "SELECT 't' || t AS tile_id, min(z) AS min_z, max(z) AS max_z, -9999.0::DOUBLE AS no_data, true AS spaced FROM (SELECT n_nationkey AS t, CASE WHEN (p * 7 + n_nationkey) % 97 = 0 THEN NULL ELSE ((p * 13 + n_nationkey * 29) % 500)::DOUBLE END AS z FROM nation, (SELECT unnest(range(1681)) AS p)) GROUP BY t",
    "offset_grid": _OFFSET,
    "offset_grid_flipped": _FLIPPED,
    "find_intersects": f"SELECT q.s_suppkey AS q_s_suppkey, f.c_custkey AS f_c_custkey FROM ({PROBES}) q JOIN ({BOXES}) f ON q.xmin <= f.xmax AND f.xmin <= q.xmax AND q.ymin <= f.ymax AND f.ymin <= q.ymax",
    "find_nearest_ties": f"SELECT q_s_suppkey, f_c_custkey, {cut_sql('d')} AS distance FROM (SELECT *, min(d) OVER (PARTITION BY q_s_suppkey) AS best FROM (SELECT q.s_suppkey AS q_s_suppkey, f.c_custkey AS f_c_custkey, sqrt(power(greatest(0, q.xmin - f.xmax, f.xmin - q.xmax), 2) + power(greatest(0, q.ymin - f.ymax, f.ymin - q.ymax), 2)) AS d FROM ({PROBES}) q CROSS JOIN ({BOXES}) f) WHERE d <= 80) WHERE d = best",
    "point_in_polygon": f"SELECT p.o_orderkey, g.geom_id FROM orders p LEFT JOIN (SELECT o_orderkey, min(geom_id) AS geom_id FROM ({inside_sql()}) GROUP BY 1) g USING (o_orderkey)",
    "semi_intersects": f"SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM ({inside_sql()}))",
    "anti_intersects": f"SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({inside_sql()}))",
    "ortho_resample": _ORTHO,
    "tre_field_extract": "SELECT p_partkey, p_size + 0.25::DOUBLE AS lat_off, p_partkey AS line_off, NULL::DOUBLE AS missing FROM part WHERE p_partkey % 2 = 1",
    "rpc_coeff_dense": "SELECT p_partkey, 20 AS n, (p_partkey % 7)::DOUBLE AS c0, 0.0::DOUBLE AS c1, p_size::DOUBLE AS c3, -1.5::DOUBLE AS c19 FROM part",
    "des_header": _des_sql(),
    "extension_normalize": "SELECT p_partkey, ['NITF','NITF','TIFF','TIFF','JPEG','JPEG','PNG','H5'][p_partkey % 8 + 1] AS extension, ['NITF','NITF','TIFF','TIFF','JPEG','JPEG','PNG','H5'][p_partkey % 8 + 1] AS plain FROM part",
    "compression_matrix": """SELECT p_partkey, CASE f WHEN 'NITF' THEN CASE WHEN c IS NULL OR c = 'J2K' THEN CASE WHEN fl THEN 'IC=NC' ELSE 'IC=C8' END WHEN c = 'JPEG' THEN 'IC=C3' WHEN c = 'NONE' THEN 'IC=NC' ELSE 'IC=C8' END
WHEN 'GTiff' THEN CASE WHEN c = 'JPEG' THEN 'COMPRESS=JPEG' WHEN c = 'NONE' THEN 'COMPRESS=NONE' ELSE 'COMPRESS=LZW' END END AS option
FROM (SELECT p_partkey, ['NITF', 'GTiff', 'PNG', 'JPEG'][p_partkey % 4 + 1] AS f, [NULL, 'NONE', 'JPEG', 'J2K', 'LZW'][(p_partkey // 4) % 5 + 1] AS c, (p_partkey // 20) % 2 = 1 AS fl FROM part)""",
    "geojson_precedence": f"SELECT event_id, {_GEO.format(chr(39) + 'imageGeometry' + chr(39), chr(39) + 'imageBBox' + chr(39), chr(39) + 'detection' + chr(39), chr(39) + 'bounds_imcoords' + chr(39))} AS source, {_GEO.format(*(chr(39) + t + chr(39) for t in ('Point', 'Polygon', 'Point', 'Polygon')))} AS type FROM events",
    "geometry_bounds": "SELECT event_id, x AS xmin, y AS ymin, x + CASE WHEN event_id % 5 IN (1, 3) THEN 10 ELSE 0 END AS xmax, y + CASE WHEN event_id % 5 IN (1, 3) THEN 20 ELSE 0 END AS ymax FROM (SELECT event_id, (event_id * 13 % 900)::DOUBLE AS x, (event_id * 29 % 700)::DOUBLE AS y FROM events WHERE event_id % 5 < 4)",
    "geolocate_grid": f"SELECT c_custkey, {cut_sql('xmin * 0.01 - 20')} AS min_lon, {cut_sql('xmax * 0.01 - 20')} AS max_lon, {cut_sql('30 - ymax * 0.005')} AS min_lat, {cut_sql('30 - ymin * 0.005')} AS max_lat, {cut_sql('(xmin + xmax) / 2 * 0.01 - 20')} AS center_longitude, {cut_sql('30 - (ymin + ymax) / 2 * 0.005')} AS center_latitude FROM ({BOXES})",
    "geolocate_geometries": f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN '[]' WHEN 1 THEN '[[][][]]' ELSE '[[[][][][]][[][][][]]]' END AS shape, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 8 END AS n, {cut_sql('x * 0.01::DOUBLE - 20', 5)} AS lon_first, {cut_sql('30 - y * 0.005::DOUBLE', 5)} AS lat_first, {cut_sql('(x + CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 20 ELSE 15 END) * 0.01::DOUBLE - 20', 5)} AS lon_last, {cut_sql('30 - (y + CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END) * 0.005::DOUBLE', 5)} AS lat_last FROM (SELECT event_id, (event_id * 13 % 900)::DOUBLE AS x, (event_id * 29 % 700)::DOUBLE AS y FROM events)",
    "display_bands": f"""WITH p AS (SELECT image, band, x % 32 AS x, y % 32 AS y, max(v) AS v FROM ({PIX}) WHERE image % 2 = 0 OR band <= 2 GROUP BY 1, 2, 3, 4), k AS (SELECT *, max(band) OVER (PARTITION BY image) AS bands FROM p),
a AS (SELECT image, band, x, y, floor(greatest(0, least(255, (v - lo) * (255.0::DOUBLE / greatest(hi, 1))))) AS display FROM (SELECT *, min(v) OVER (PARTITION BY image, band) AS lo, max(v) OVER (PARTITION BY image, band) AS hi FROM k WHERE bands = 1 OR (bands >= 3 AND band <= 3))),
m AS (SELECT image, sqrt(sum(m * m)) AS mean FROM (SELECT image, band, avg(v) + stddev_pop(v) * (50.0::DOUBLE / 68) AS m FROM k WHERE bands = 2 GROUP BY 1, 2) GROUP BY image),
b AS (SELECT s.image, 1 AS band, x, y, floor(greatest(0, least(255, 255 * sqrt(power) / (3 * mean)))) AS display FROM (SELECT image, x, y, sum(v * v) AS power FROM k WHERE bands = 2 GROUP BY 1, 2, 3 HAVING count(*) = 2) s JOIN m USING (image)),
d AS (SELECT image, x, y, list(display ORDER BY band) AS l FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2, 3)
SELECT image, CAST(len(l) AS INTEGER) AS n, count(*) AS pixels, CAST(sum(l[1]) AS BIGINT) AS one, CAST(sum(l[3]) AS BIGINT) AS three FROM d GROUP BY 1, 2""",
    "sar_pfa_rrdot": f"SELECT o_orderkey, {cut_sql('r0 + k * al', 3)} AS r, {cut_sql('d0 + (0.002::DOUBLE * al + k * ac) * 0.01::DOUBLE', 5)} AS rdot FROM (SELECT *, 1 + 0.002::DOUBLE * th AS k, rg * cos(th) + az * sin(th) AS al, az * cos(th) - rg * sin(th) AS ac FROM (SELECT *, 0.01::DOUBLE * t AS th FROM {_TO_SCP}))",
    "sar_rgazcomp_rrdot": f"SELECT o_orderkey, {cut_sql('r0 + rg', 3)} AS r, {cut_sql('d0 - sqrt(vy * vy + vz * vz) * 1e-6 * az', 5)} AS rdot FROM {_TO_SCP}",
    "sar_inca_rrdot": f"SELECT o_orderkey, {cut_sql('r', 3)} AS r, {cut_sql(f'f / r * {_V2} * dt', 5)} AS rdot FROM {_INCA}",
    "sar_plane_project": _PLANE,
    "sar_height_project": "SELECT o_orderkey, 100.0::DOUBLE AS hae, true AS in_range, true AS in_rate, 'R' AS side FROM orders",
    "contour_crossings": f"SELECT user_id, step, {cut_sql('CASE WHEN s = 0 THEN 0 ELSE d / (d - nd) END')} AS fraction FROM (SELECT *, lead(d) OVER w AS nd, lead(s) OVER w AS ns FROM (SELECT user_id, event_id AS step, value - 50.0::DOUBLE AS d, CASE WHEN abs(value - 50.0::DOUBLE) < 0.001 THEN 0 WHEN value - 50.0::DOUBLE > 0.001 THEN 1 ELSE -1 END AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY step)) WHERE s = 0 OR s * ns = -1",
    "sidd_bilinear_chip": _sidd_sql(),
}
