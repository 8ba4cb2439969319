"""One table of sensor models of all kinds, and pixels of mixed images to the ground and back by it.

A row of the table is an image: the kinds of its approximate and its precise model, and a nullable struct of parameters
for each kind.  Pixels are split by the kind that answers for them; each part joins its own parameters alone, is solved
by that kind's operator, and the parts are united.  Pixels keep all their columns, whatever their names; pixels of images
that the table does not know, or knows without a model, keep nulls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.functions import projections as J
from orbitframe.functions import projective as M
from orbitframe.lineage import written
from orbitframe.operators import models, sar, statistics
from orbitframe.sources import des, products, tre

#: Kinds of models that can be asked for; PROJECTIVE stands for control points and corner records, SICD for complex products. Derived products are always read.
SELECTABLE = ("AFFINE", "PROJECTIVE", "RPC", "RSM", "SICD")
#: What an image's row may have besides its key; columns that are missing count as null.
IMAGE_COLUMNS = {"width": "double", "height": "double", "tres": "string", "dess": "string", "geo_transform": "array<double>", "crs": "string", "gcps": "array<struct<lon_deg:double,lat_deg:double,pixel:double,line:double>>"}


def build(images: DataFrame, key: str = "image_id", selected: tuple[str, ...] = SELECTABLE) -> DataFrame:
    """The table of models: key, approximate, precise, model, affine, plane, plane_chipped, chip, rpc, rsm and sar.

    Later kinds replace earlier ones: affine, control points, corner record; and rational, replacement, product.  A chip
    record holds for the corner record and the first two precise kinds, a derived product has its own chip.  Images need
    four control points; a singular transform is no model, an unknown reference system an error.  The table is written to
    a shared folder, since each part of a search joins it and the records would be parsed for each.

    What the kinds read is united and grouped by image, and the joins within a kind are told to merge: Spark guesses
    texts and arrays much smaller than they are, and would send tables that grow with the images through the driver.
    """
    rows = written(images.select(F.col(key).alias("key"), *((F.col(n) if n in images.columns else F.lit(None)).cast(t).alias(n) for n, t in IMAGE_COLUMNS.items())))  # each kind reads it
    records = rows.where("tres is not null")
    corners = written(tre.chip_corners(records, "tres", "key"))  # parsed records are written, as several joins read them
    chips = statistics.fit_homography(_merged(corners.select("key", F.inline("corners"))), "key", ("full_x", "full_y"), ("chip_x", "chip_y"))
    gt = F.col("geo_transform")
    sound = (F.size(gt) == 6) & (gt[1] * gt[5] - gt[2] * gt[4] != 0)
    affine = J.constants(rows.where(sound & F.lit("AFFINE" in selected))).select("key", F.struct(gt.alias("gt"), "system").alias("affine"))
    points = rows.where(F.lit("PROJECTIVE" in selected)).select("key", F.inline("gcps"))
    placed = statistics.fit_homography(_merged(points), "key", ("lon_deg", "lat_deg"), ("pixel", "line"))
    sized = records.where(F.col("tres").contains("CSCRNA") & F.lit("PROJECTIVE" in selected)).join(_merged(corners.select("key", "full_cols", "full_rows")), "key", "left").withColumns({"width": F.coalesce("full_cols", "width"), "height": F.coalesce("full_rows", "height")})
    record_points = written(tre.corner_points(sized, F.col("width"), F.col("height"), "tres", "key").where("lon_deg is not null and lat_deg is not null and pixel is not null and line is not null"))
    recorded = statistics.fit_homography(_merged(record_points), "key", ("lon_deg", "lat_deg"), ("pixel", "line"))
    rational = tre.rpc_parameters(records.where(F.lit("RPC" in selected)), "tres", "key").select("key", F.struct(*models.RPC_NORMS, *models.RPC_POLYS).alias("rpc"))
    replaced = records.where(F.lit("RSM" in selected))
    sections = models.rsm_models(_merged(written(tre.rsm_parameters(replaced, "tres", "key"))), tre.rsm_sections(replaced, "tres", "key"), "key")
    replacement = sections.groupBy("key").agg(F.collect_list(F.struct(*(c for c in sections.columns if c != "key"))).alias("rsm"))  # an image's sections
    found = des.by_name(des.segments(rows.where("dess is not null"), "dess", "key"), "XML_DATA_CONTENT").withColumn("xml", des.data_xml(F.col("fields"), F.col("segment")))
    kind = F.when(F.col("xml").contains("SIDD"), "SIDD").when(F.col("xml").contains("SICD") & F.lit("SICD" in selected), "SICD")
    first = written(found.withColumn("kind", kind).where("kind is not null").groupBy("key").agg(F.min_by(F.struct("kind", "xml"), "position").alias("d")).select("key", "d.*"))
    derived = products.with_chips(_merged(written(products.sidd(first.where("kind = 'SIDD'"), key="key"))), "key")
    complex_ = products.sicd(first.where("kind = 'SICD'"), key="key").withColumn("chip_h", F.lit(None).cast("array<double>"))
    both = derived.select("key", F.lit("SIDD").alias("product"), *sar.SAR_MODEL, "chip_h").unionByName(complex_.select("key", F.lit("SICD").alias("product"), *sar.SAR_MODEL, "chip_h"))
    product = both.select("key", "product", F.struct(*sar.SAR_MODEL, "chip_h").alias("sar"))
    parts = [rows.select("key"), chips.withColumnRenamed("h", "chip"), affine, placed.withColumnRenamed("h", "points_plane"), recorded.withColumnRenamed("h", "record_plane"), rational, replacement, product]
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).repartition("key")  # sorted once, for the grouping
    out = united.groupBy("key").agg(*(F.first(n, ignorenulls=True).alias(n) for n in united.columns if n != "key"))
    c = F.col
    approximate = F.when(c("record_plane").isNotNull(), "CSCRNA").when(c("points_plane").isNotNull(), "GCP").when(c("affine").isNotNull(), "AFFINE")
    precise = F.when(c("sar").isNotNull(), c("product")).when(c("rsm").isNotNull(), "RSM").when(c("rpc").isNotNull(), "RPC")
    out = out.withColumns({"approximate": approximate, "precise": precise})
    model = F.when(c("approximate").isNotNull() & c("precise").isNotNull(), "COMPOSITE").otherwise(F.coalesce("precise", "approximate"))
    only = lambda name, kinds: F.when(c("precise").isin(*kinds), c(name)).alias(name)
    return written(out.select(
        c("key").alias(key), "approximate", "precise", model.alias("model"), F.when(c("approximate") == "AFFINE", c("affine")).alias("affine"), F.coalesce("record_plane", "points_plane").alias("plane"), (c("approximate") == "CSCRNA").alias("plane_chipped"),
        "chip", only("rpc", ["RPC"]), only("rsm", ["RSM"]), only("sar", ["SICD", "SIDD"]),
    ))


def _merged(df: DataFrame) -> DataFrame:
    """The frame for a join that sorts and merges both sides, whatever Spark takes their sizes for."""
    return df.hint("merge")


def _given(df: DataFrame, key: str, x: str | None, y: str | None, height: str | None, **more: str) -> DataFrame:
    """The rows packed whole, with what the solvers ask for beside them."""
    number = lambda n: F.lit(None).cast("double") if n is None else F.col(n).cast("double")
    return df.select(F.struct("*").alias("mt_row"), F.col(key).alias("mt_key"), number(x).alias("mt_x"), number(y).alias("mt_y"), number(height).alias("mt_h"), *(number(v).alias(k) for k, v in more.items()))


def _parameters(table: DataFrame, key: str, *names: str) -> DataFrame:
    return _merged(table.select(F.col(key).alias("mt_key"), *(F.col(n).alias(f"mt_{n}") for n in names)))


def _of_kinds(given: DataFrame, table: DataFrame, key: str, kinds: tuple[str, ...], *names: str) -> DataFrame:
    """Pixels of the images whose precise model is of the kinds, with these parameters."""
    return given.join(_parameters(table.where(F.col("precise").isin(*kinds)), key, "model", *names), "mt_key")


def _coefficients(name: str) -> list[Column]:
    return [F.col(name)[i] for i in range(8)]


def _full(rows: DataFrame) -> tuple[Column, Column]:
    """Pixels of a chip in the full image."""
    full = M.homography_inverse(_coefficients("mt_chip"), F.col("mt_x"), F.col("mt_y"))
    return tuple(F.when(F.col("mt_chip").isNull(), F.col(n)).otherwise(f) for n, f in zip(("mt_x", "mt_y"), full, strict=True))


def _onto_chip(x: Column, y: Column) -> tuple[Column, Column]:
    chip = M.homography(_coefficients("mt_chip"), x, y)
    return tuple(F.when(F.col("mt_chip").isNull(), v).otherwise(c) for v, c in zip((x, y), chip, strict=True))


def _approximately(rows: DataFrame, wrapped: bool = True) -> DataFrame:
    """Adds _lon and _lat by the approximate model, null where there is none."""
    full = _full(rows)
    px, py = (F.when(F.col("mt_plane_chipped"), f).otherwise(F.col(n)) for n, f in zip(("mt_x", "mt_y"), full, strict=True))
    names = rows.columns
    east, north = M.affine(F.col("mt_affine.gt"), F.col("mt_x"), F.col("mt_y"))
    rows = rows.withColumns({"mt_px": px, "mt_py": py, "mt_east": east, "mt_north": north, "mt_system": F.col("mt_affine.system")})
    rows = J.unproject(rows, "mt_east", "mt_north", "mt_system", ("mt_alon", "mt_alat"), wrapped)
    lon, lat = M.homography_inverse(_coefficients("mt_plane"), F.col("mt_px"), F.col("mt_py"))
    flat = F.col("mt_affine").isNull()
    return rows.select(*names, F.when(flat, lon).otherwise(F.col("mt_alon")).alias("mt_lon"), F.when(flat, lat).otherwise(F.col("mt_alat")).alias("mt_lat"))


def locate(pixels: DataFrame, table: DataFrame, key: str = "image_id", x: str = "x", y: str = "y", height: str | None = None, wrapped: bool = True) -> DataFrame:
    """Pixels with model, lon_deg, lat_deg and elev of their places, by the best model of their image.

    height names a column with the height to solve for.  Where it is null, rational models take their height offset,
    replacement models their own height, products the plane through their centre point, others 0.  A rational model
    starts at the approximate place, and that place stays where it finds none.  Not wrapped, longitudes of projected
    images are counted from their system's meridian on and may pass 180.
    """
    given = _given(pixels, key, x, y, height)
    approximate = ("affine", "plane", "plane_chipped", "chip")
    kept = ["mt_row", "mt_key", "mt_x", "mt_y", "mt_h", "mt_model"]
    flat = given.join(_parameters(table, key, "model", "precise", *approximate), "mt_key", "left").where("mt_precise is null").drop("mt_precise")
    plates = _approximately(flat, wrapped)
    parts = [plates.select("mt_row", "mt_model", "mt_lon", "mt_lat", F.coalesce("mt_h", F.when(F.col("mt_lon").isNotNull(), F.lit(0.0))).alias("mt_up"))]

    rational = _approximately(_of_kinds(given, table, key, ("RPC",), *approximate, "rpc"))
    fx, fy = _full(rational)
    rational = rational.select(*kept, fx.alias("mt_fx"), fy.alias("mt_fy"), "mt_lon", "mt_lat", "mt_rpc.*").withColumn("mt_up", F.coalesce("mt_h", "height_off"))
    solved = models.rpc_inverse(rational, "mt_fx", "mt_fy", "mt_up", ("mt_lon", "mt_lat"))
    parts.append(solved.select("mt_row", "mt_model", F.coalesce("lon_deg", "mt_lon").alias("mt_lon"), F.coalesce("lat_deg", "mt_lat").alias("mt_lat"), "mt_up"))

    sections = _merged(table.where("rsm is not null").select(F.col(key).alias("mt_key"), F.inline("rsm")))
    replaced = _of_kinds(given, table, key, ("RSM",), "chip")
    fx, fy = _full(replaced)
    solved = models.rsm_image_to_world(replaced.withColumns({"mt_fx": fx, "mt_fy": fy}).select(*kept, "mt_fx", "mt_fy"), sections, "mt_key", "mt_fx", "mt_fy", "mt_h")
    parts.append(solved.select("mt_row", "mt_model", F.col("lon_deg").alias("mt_lon"), F.col("lat_deg").alias("mt_lat"), F.col("height").alias("mt_up")))

    products_ = table.where("sar is not null").select(F.col(key).alias("mt_key"), "sar.*")
    imaged = _merged(_of_kinds(given, table, key, ("SICD", "SIDD")).select(*kept))
    solved = sar.image_to_world(imaged.where("mt_h is null"), products_, "mt_key", "mt_x", "mt_y")
    parts.append(solved.select("mt_row", "mt_model", F.col("lon_deg").alias("mt_lon"), F.col("lat_deg").alias("mt_lat"), F.col("height").alias("mt_up")))
    if height is not None:
        high = sar.contours(imaged.where("mt_h is not null"), products_, "mt_key", "mt_x", "mt_y").withColumn("mt_scp", F.col("sar.scp"))
        high = sar.on_height(high, "r", "rdot", "arp", "varp", "mt_scp", F.col("sar.side"), F.col("mt_h"), "mt_at")
        parts.append(sar.with_geodetic(high, F.col("mt_at"), ("mt_lon", "mt_lat", "mt_up")).select("mt_row", "mt_model", "mt_lon", "mt_lat", "mt_up"))
    out = reduce(DataFrame.unionByName, parts)
    names = [c for c in pixels.columns if c not in ("model", "lon_deg", "lat_deg", "elev")]
    return out.select(*(F.col("mt_row")[n].alias(n) for n in names), F.col("mt_model").alias("model"), F.col("mt_lon").alias("lon_deg"), F.col("mt_lat").alias("lat_deg"), F.col("mt_up").alias("elev"))


def find_pixels(places: DataFrame, table: DataFrame, key: str = "image_id", lon_deg: str = "lon_deg", lat_deg: str = "lat_deg", height: str | None = "height") -> DataFrame:
    """Places with model, x and y of their pixels, by the best model of their image; a null height counts as 0."""
    given = _given(places, key, None, None, height, mt_lon=lon_deg, mt_lat=lat_deg).withColumn("mt_h", F.coalesce("mt_h", F.lit(0.0))).drop("mt_x", "mt_y")
    given = given.join(_parameters(table, key, "model", "precise"), "mt_key", "left")
    part = lambda *kinds: given.where(F.col("mt_precise").isin(*kinds)).drop("mt_precise")
    flat = given.where("mt_precise is null").drop("mt_precise").join(_parameters(table, key, "affine", "plane", "plane_chipped", "chip"), "mt_key", "left").withColumn("mt_system", F.col("mt_affine.system"))
    flat = J.project(flat, "mt_lon", "mt_lat", "mt_system", ("mt_east", "mt_north"))
    ax, ay = M.affine_inverse(F.col("mt_affine.gt"), F.col("mt_east"), F.col("mt_north"))
    px, py = M.homography(_coefficients("mt_plane"), F.col("mt_lon"), F.col("mt_lat"))
    flat = flat.withColumns({"mt_px": px, "mt_py": py})
    cx, cy = _onto_chip(F.col("mt_px"), F.col("mt_py"))
    pick = lambda a, p, c: F.when(F.col("mt_affine").isNotNull(), a).when(F.col("mt_plane_chipped"), c).otherwise(p)
    parts = [flat.select("mt_row", "mt_model", pick(ax, F.col("mt_px"), cx).alias("mt_x"), pick(ay, F.col("mt_py"), cy).alias("mt_y"))]

    rational = part("RPC").join(_parameters(table, key, "rpc", "chip"), "mt_key")
    samp, line = models.rpc_forward(F.col("mt_lon"), F.col("mt_lat"), F.col("mt_h"), lambda n: F.col("mt_rpc")[n])
    rational = rational.withColumns({"mt_px": samp, "mt_py": line})
    cx, cy = _onto_chip(F.col("mt_px"), F.col("mt_py"))
    parts.append(rational.select("mt_row", "mt_model", cx.alias("mt_x"), cy.alias("mt_y")))

    sections = _merged(table.where("rsm is not null").select(F.col(key).alias("mt_key"), F.inline("rsm")))
    replaced = models.rsm_world_to_image(part("RSM").select("mt_row", "mt_key", "mt_model", F.col("mt_lon").alias("mt_to"), F.col("mt_lat").alias("mt_ta"), "mt_h"), sections, "mt_key", "mt_to", "mt_ta", "mt_h").withColumnsRenamed({"x": "mt_px", "y": "mt_py"}).join(_parameters(table, key, "chip"), "mt_key")
    cx, cy = _onto_chip(F.col("mt_px"), F.col("mt_py"))
    parts.append(replaced.select("mt_row", "mt_model", cx.alias("mt_x"), cy.alias("mt_y")))

    products_ = table.where("sar is not null").select(F.col(key).alias("mt_key"), "sar.*")
    imaged = sar.world_to_image(_merged(part("SICD", "SIDD")), products_, "mt_key", "mt_lon", "mt_lat", "mt_h")
    parts.append(imaged.select("mt_row", "mt_model", F.col("x").alias("mt_x"), F.col("y").alias("mt_y")))
    out = reduce(DataFrame.unionByName, parts)
    names = [c for c in places.columns if c not in ("model", "x", "y")]
    return out.select(*(F.col("mt_row")[n].alias(n) for n in names), F.col("mt_model").alias("model"), F.col("mt_x").alias("x"), F.col("mt_y").alias("y"))
