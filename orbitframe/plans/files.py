"""Rasters written as files by the sink and read back by the data source, and polygons stored by cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.lineage import dealt, shared_folder
from orbitframe.operators import blocks
from orbitframe.plans.imagery import DIAMOND, HOLE, inside_sql
from orbitframe.plans.relations import PIX, PTS, pix, pts
from orbitframe.sources import raster_files, tre, vectors

#: Pixels of a file's side, and of an image's.
FILE, SIDE = 256, 512


def _infos(spark: SparkSession, folder: str) -> DataFrame:
    """What the files of a folder say of themselves, by their names."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return raster_files.read_info(paths).withColumn("file", F.substring_index("image", "/", -1))


def raster_file_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of two bands of eight images, each in four files; band and rows reach the reader as filters."""
    rows = pix(spark, sf_dir).groupBy("image", "band", "x", "y").agg(F.sum("v").alias("v"))
    images = rows.select("image").distinct().withColumns({"width": F.lit(SIDE), "height": F.lit(SIDE), "gt": F.array(F.col("image") * 1000.0, F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))})
    level0 = blocks.whole_blocks(blocks.from_pixels(rows, FILE), images, FILE)
    folder = shared_folder(spark)
    raster_files.write_tiles(raster_files.chips(level0, "float64", images, FILE), folder)
    read = raster_files.read_blocks(spark, folder).where("band in (1, 2) and top <= 100").withColumn("file", F.substring_index("image", "/", -1))
    placed = read.join(_infos(spark, folder).select("file", "gt"), "file")
    g = F.col("gt")
    placed = placed.withColumns({"image": F.floor(g[0] / 1000), "left": F.col("left") + g[0].cast("int") % 1000, "top": F.col("top") + g[3].cast("int")})
    return blocks.to_pixels(placed).where("x between 200 and 300 and y between 40 and 100 and v > 0")


def nitf_model_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A NITF file per supplier with a rational model and an extension, read back as pixels and model parameters."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey", (F.col("l_linenumber") - 1).alias("x"), (F.col("l_quantity").cast("int") % 3).alias("y")).agg(F.count("*").alias("n"))
    cells = F.collect_list(F.struct((F.col("y") * 7 + F.col("x")).cast("int").alias("at"), F.col("n").cast("double").alias("n")))
    found = rows.groupBy("l_suppkey").agg(F.map_from_entries(cells).alias("cells"))
    k = F.col("l_suppkey")
    number = lambda form, v: F.format_string(form, v)
    polynomial = "".join(f"{f'+0.{i:06d}E+0':>12}" for i in range(20))
    record = F.concat(F.lit("10000.500000.25"), number("%06d", k % 1000000), F.lit("03000"), number("%+08.4f", (k % 80).cast("double") + 0.25), number("%+09.4f", (k % 170).cast("double") - 0.5), F.lit("+0100"), F.lit("00200003000+00.1000+000.1000+0500" + polynomial * 4))
    named = lambda name, data: F.array(F.struct(F.lit(name).alias("name"), data.cast("binary").alias("data")))
    tiles = found.select(
        F.concat(F.lit("s"), k).alias("name"), F.lit(7).alias("width"), F.lit(3).alias("height"), F.lit(1).alias("bands"), F.lit("int32").alias("kind"), F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(0.0))).alias("v"),
        named("RPC00B", record).alias("records"), named("XML_DATA_CONTENT", F.concat(F.lit("<supplier>"), k, F.lit("</supplier>"))).alias("extensions"),
    )
    folder = shared_folder(spark)
    raster_files.write_tiles(dealt(tiles), folder, "nitf")
    said = F.xpath_long(F.col("extensions")[0]["data"].cast("string"), F.lit("/supplier"))
    info = _infos(spark, folder).select(F.struct("file", said.alias("suppkey")).alias("id"), "xml")  # one pass over the headers
    models = tre.rpc_parameters(info, key="id").select("id.*", "line_off", "lat_off", "long_off", F.col("samp_den")[19].alias("last"))
    pixels = raster_files.read_blocks(spark, folder).select(F.substring_index("image", "/", -1).alias("file"), F.posexplode("v").alias("at", "n"))
    return pixels.where("n > 0").join(models, "file").select("suppkey", (F.col("at") % 7).alias("x"), F.floor(F.col("at") / 7).cast("int").alias("y"), F.col("n").cast("long").alias("n"), "line_off", "lat_off", "long_off", "last")


#: A region of places, which touches few of the stored parts.
WEST, EAST, SOUTH, NORTH = -140, 20, -30, 60


def stored_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a region with all stored polygons that hold them; only the parts with places are read."""
    k, folder = F.col("s_suppkey"), shared_folder(spark)
    x, y = k * 37 % 340 - 170, k * 53 % 150 - 75
    ring = lambda places: F.format_string("[" + ",".join(["[%s,%s]"] * len(places)) + "]", *(v for a, b in places for v in ((x + a).cast("string"), (y + b).cast("string"))))
    geometry = F.concat(F.lit('{"type":"Polygon","coordinates":['), ring(DIAMOND), F.lit(","), ring(HOLE), F.lit("]}"))
    vectors.store_polygons(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("geom_id"), geometry.alias("geometry")), folder, "geom_id")
    places = pts(spark, sf_dir).where(F.col("lon_deg").between(WEST, EAST) & F.col("lat_deg").between(SOUTH, NORTH))
    return vectors.stored_holders(places, folder, "lon_deg", "lat_deg").select("o_orderkey", F.col("key").alias("geom_id"))


QUERIES = {"raster_file_window": raster_file_window, "nitf_model_tiles": nitf_model_tiles, "stored_polygons": stored_polygons}
ORACLES = {
    "raster_file_window": f"SELECT image, CAST(band AS INTEGER) AS band, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, sum(v)::DOUBLE AS v FROM ({PIX}) WHERE x BETWEEN 200 AND 300 AND y BETWEEN 40 AND 100 AND band IN (1, 2) GROUP BY ALL",
    "nitf_model_tiles": "SELECT l_suppkey AS suppkey, CAST(l_linenumber - 1 AS INTEGER) AS x, CAST(l_quantity AS INTEGER) % 3 AS y, count(*) AS n, (l_suppkey % 1000000)::DOUBLE AS line_off, l_suppkey % 80 + 0.25::DOUBLE AS lat_off, l_suppkey % 170 - 0.5::DOUBLE AS long_off, 0.000019::DOUBLE AS last FROM lineitem GROUP BY 1, 2, 3",
    "stored_polygons": f"SELECT o_orderkey, geom_id FROM ({inside_sql()}) JOIN ({PTS}) USING (o_orderkey) WHERE lon_deg BETWEEN {WEST} AND {EAST} AND lat_deg BETWEEN {SOUTH} AND {NORTH}",
}
