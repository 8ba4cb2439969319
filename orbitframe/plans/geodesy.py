"""Coordinates, tiles, polynomials and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.functions import geodesy as G
from orbitframe.functions import polynomials as P
from orbitframe.functions import projective as M
from orbitframe.functions import web_tiles as W
from orbitframe.lineage import dealt
from orbitframe.operators import elevation as E
from orbitframe.operators import models, statistics
from orbitframe.plans.relations import PTS, cut, cut_sql, pts
from orbitframe.sources import tre

WGS = {"a": "6378137.0::DOUBLE", "e2": "0.006694379990141317::DOUBLE"}
R = "6378137.0::DOUBLE"
LON, LAT = "radians(lon_deg)", "radians(lat_deg)"


def rad() -> tuple:
    return F.radians("lon_deg"), F.radians("lat_deg")


def _tile_sql(z: int, lon: str = LON, lat: str = LAT) -> tuple[str, str]:
    res = f"(2 * pi() * {R} / 256 / {2.0**z}::DOUBLE)"
    row = f"CAST(ceil(({R} * ln(tan(pi() / 4 + {lat} / 2)) + pi() * {R}) / {res} / 256) - 1 AS BIGINT)"
    col = f"CAST(ceil(({R} * {lon} + pi() * {R}) / {res} / 256) - 1 AS BIGINT)"
    return row, col


def wmq_tile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    row, col = W.tile_of(*rad(), F.lit(4))
    return pts(spark, sf_dir).groupBy(row.alias("tile_row"), col.alias("tile_col")).agg(F.count("*").alias("n"), F.min("elev").alias("min_elev"), F.max("elev").alias("max_elev"))


def wmq_tile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.lit(10)
    row, col = W.tile_of(*rad(), z)
    rows = pts(spark, sf_dir).select(row.alias("tile_row"), col.alias("tile_col")).distinct()
    b = W.tile_bounds(z, F.col("tile_row"), F.col("tile_col"))
    return rows.select("tile_row", "tile_col", *(cut(v, 9).alias(n) for v, n in zip(b, ("west", "south", "east", "north"), strict=True)))


def wmq_area_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    row, col = W.tile_of(*rad(), F.lit(8))
    rows = pts(spark, sf_dir).select((F.col("o_custkey") % 50).alias("area"), row.alias("row"), col.alias("col"))
    return statistics.tile_limits(rows, ["area"])


def lla_to_ecef(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = G.geodetic_to_ecef(*rad(), F.col("elev"))
    return pts(spark, sf_dir).select("o_orderkey", *(cut(v, 4).alias(n) for v, n in ((x, "x"), (y, "y"), (z, "z"))))


def ecef_to_lla(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pts(spark, sf_dir)
    x, y, z = G.geodetic_to_ecef(*rad(), F.col("elev"))
    rows = rows.withColumns({"x": x, "y": y, "z": z})
    lon, lat, elev = G.ecef_to_geodetic(F.col("x"), F.col("y"), F.col("z"))
    return rows.select("o_orderkey", cut(F.degrees(lon)).alias("lon_back"), cut(F.degrees(lat)).alias("lat_back"), cut(elev, 3).alias("elev_back"))


def normalize_lonlat(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = G.normalized(F.radians(F.col("lon_deg") * 3 + 0.25), F.radians(F.col("lat_deg") * 3 + 0.25))
    return pts(spark, sf_dir).select("o_orderkey", cut(F.degrees(lon)).alias("lon_n"), cut(F.degrees(lat)).alias("lat_n"))


def range_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = G.range_adjusted(*rad(), G.PI * 2, G.PI * 4, -G.PI / 2, G.PI / 2)
    return pts(spark, sf_dir).select("o_orderkey", cut(F.degrees(got["lon"])).alias("lon_r"), cut(F.degrees(got["lat"])).alias("lat_r"))


def dms_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pts(spark, sf_dir).select("o_orderkey", G.dms(*rad()).alias("dms"))


def srtm_tile_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an eighth of a degree keeps places off the degree lines
    lon, lat = F.radians(F.floor("lon_deg") + 0.125), F.radians(F.floor("lat_deg") + 0.125)
    return pts(spark, sf_dir).select("o_orderkey", E.srtm_tile_id(lon, lat).alias("tile_id"))


def generic_tile_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = F.radians(F.floor("lon_deg") + 0.125), F.radians(F.floor("lat_deg") + 0.125)
    return pts(spark, sf_dir).select("o_orderkey", E.tile_id("dted/%oh%od/%lh%ld.dt2", lon, lat, (-120, 120), (-60, 60)).alias("tile_id"))


def affine_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = F.array(*(F.lit(v) for v in (-180.0, 0.01, 0.001, 80.0, 0.0005, -0.01)))
    rows = pts(spark, sf_dir).withColumn("gt", gt)
    px, py = M.affine_inverse(F.col("gt"), F.col("lon_deg"), F.col("lat_deg"))
    rows = rows.withColumns({"px": px, "py": py})
    lon, lat = M.affine(F.col("gt"), F.col("px"), F.col("py"))
    return rows.select("o_orderkey", cut(F.col("px"), 4).alias("px"), cut(F.col("py"), 4).alias("py"), cut(lon).alias("lon_back"), cut(lat).alias("lat_back"))


#: A fixed homography for the queries.
H = (1.5, 0.9, 0.05, -2.0, -0.04, 1.1, 0.0004, -0.0003)


def homography_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = M.homography([F.lit(h) for h in H], F.col("lon_deg"), F.col("lat_deg"))
    return pts(spark, sf_dir).select("o_orderkey", cut(u, 5).alias("u"), cut(v, 5).alias("v"))


def homography_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = [F.lit(c) for c in H]
    u, v = M.homography(h, F.col("lon_deg"), F.col("lat_deg"))
    rows = pts(spark, sf_dir).withColumns({"u": u, "v": v})
    x, y = M.homography_inverse(h, F.col("u"), F.col("v"))
    return rows.select("o_orderkey", cut(x, 5).alias("x"), cut(y, 5).alias("y"))


def homography_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = M.homography([F.lit(h) for h in H], F.col("lon_deg"), F.col("lat_deg"))
    rows = pts(spark, sf_dir).select((F.col("o_custkey") % 20).alias("image"), "lon_deg", "lat_deg", u.alias("u"), v.alias("v"))
    fit = statistics.fit_homography(rows, "image", ("lon_deg", "lat_deg"), ("u", "v"))
    return fit.select("image", *(cut(F.col("h")[i], 4).alias(f"h{i}") for i in range(8)))


def chip_to_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = [(F.lit(100.0), F.lit(50.0)), (F.lit(1123.0), F.lit(60.0)), (F.lit(1100.0), F.lit(1080.0)), (F.lit(90.0), F.lit(1070.0))]
    col, row = (F.col("o_orderkey") % 512).cast("double"), (F.col("o_custkey") % 512).cast("double")
    x, y = M.chip_to_full(col, row, F.lit(512.0), F.lit(512.0), corners)
    return pts(spark, sf_dir).select("o_orderkey", cut(x, 5).alias("full_x"), cut(y, 5).alias("full_y"))


def _rpc(seed: float) -> list[float]:
    return [round(seed * ((7 * i) % 11 - 5) / 1e4, 6) for i in range(20)]


#: A fixed rational model: nearly a plate with small curvature.
RPC = {"line_num": [0.01, 0.02, -1.01, 0.03, *_rpc(1.0)[4:]], "line_den": [1.0, *_rpc(0.7)[1:]], "samp_num": [-0.02, 0.99, 0.015, -0.01, *_rpc(1.3)[4:]], "samp_den": [1.0, *_rpc(0.4)[1:]]}
NORMS = {"line_off": 5000.0, "samp_off": 6000.0, "lat_off": 0.0, "long_off": 0.0, "height_off": 4500.0, "line_scale": 5000.0, "samp_scale": 6000.0, "lat_scale": 80.0, "long_scale": 180.0, "height_scale": 4500.0}


def with_rpc(df: DataFrame) -> DataFrame:
    """Rows with the model's parameters by a join, as with a table of images."""
    spark = df.sparkSession
    names = list(NORMS) + list(RPC)
    kinds = "image_id int, " + ", ".join(f"{n} {'array<double>' if n in RPC else 'double'}" for n in names)
    parameters = spark.createDataFrame([(0, *NORMS.values(), *RPC.values())], kinds)
    return models.with_parameters(df.withColumn("image_id", F.lit(0)), parameters)


def rpc_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    samp, line = models.rpc_forward(F.col("lon_deg"), F.col("lat_deg"), F.col("elev"))
    return with_rpc(pts(spark, sf_dir)).select("o_orderkey", cut(samp, 4).alias("samp"), cut(line, 4).alias("line"))


def rpc_inverse_newton(spark: SparkSession, sf_dir: str) -> DataFrame:
    samp, line = models.rpc_forward(F.col("lon_deg"), F.col("lat_deg"), F.col("elev"))
    rows = with_rpc(pts(spark, sf_dir)).withColumns({"x": samp, "y": line, "height": F.col("elev")}).drop("lon_deg", "lat_deg")
    got = models.rpc_inverse(rows)
    return got.select("o_orderkey", cut(F.col("lon_deg"), 5).alias("lon"), cut(F.col("lat_deg"), 5).alias("lat"), (F.col("residual") < 1e-3).alias("close"))


def _terrain(lon: Column, lat: Column) -> Column:
    """A smooth terrain: a plane that rises to the north-east."""
    return 3000.0002 + 2.0 * lon + 5.0 * lat


def rpc_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of places on a terrain, back to these places without knowing their height."""
    samp, line = models.rpc_forward(F.col("lon_deg"), F.col("lat_deg"), F.col("ground"))
    rows = with_rpc(dealt(pts(spark, sf_dir)).withColumn("ground", _terrain(F.col("lon_deg"), F.col("lat_deg")))).withColumns({"x": samp, "y": line}).drop("lon_deg", "lat_deg", "ground")
    got = models.rpc_inverse_on_terrain(rows, lambda df: df.withColumn("terrain", _terrain(F.col("lon_deg"), F.col("lat_deg"))), rounds=6)
    return got.select("o_orderkey", cut(F.col("lon_deg"), 4).alias("lon"), cut(F.col("lat_deg"), 4).alias("lat"), cut(F.col("height"), 2).alias("height"))


def composite_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plate's places start the rational model's search; images without one keep the plate's place."""
    samp, line = models.rpc_forward(F.col("lon_deg"), F.col("lat_deg"), F.col("elev"))
    rows = with_rpc(pts(spark, sf_dir)).withColumns({"x": samp, "y": line, "height": F.col("elev")}).drop("lon_deg", "lat_deg")
    rows = rows.withColumn("line_den", F.when(F.col("o_orderkey") % 4 > 0, F.col("line_den")))
    gt = F.array(*(F.lit(v) for v in (-180.0, 0.03, 0.0, 80.0, 0.0, -0.016)))
    got = models.rpc_composite(rows, M.affine(gt, F.col("x"), F.col("y")))
    near = (F.abs(F.col("lon_deg") - (0.03 * F.col("x") - 180)) < 1e-9) & (F.abs(F.col("lat_deg") - (80 - 0.016 * F.col("y"))) < 1e-9)
    exact = F.col("o_orderkey") % 4 > 0
    return got.select("o_orderkey", F.when(exact, cut(F.col("lon_deg"), 5)).alias("lon"), F.when(exact, cut(F.col("lat_deg"), 5)).alias("lat"), F.when(~exact, near).alias("plate"))


def _rpc_sql() -> str:
    l, p, h = "(lon_deg / 180.0::DOUBLE)", "(lat_deg / 80.0::DOUBLE)", "((elev - 4500.0::DOUBLE) / 4500.0::DOUBLE)"
    poly = lambda c: " + ".join(f"({v!r}::DOUBLE)" + "".join(f" * {x}" for x, k in zip((l, p, h), t, strict=True) for _ in range(k)) for v, t in zip(c, P.RPC_TERMS, strict=True))
    return f"SELECT o_orderkey, {cut_sql(f'(({poly(RPC['samp_num'])}) / ({poly(RPC['samp_den'])})) * 6000.0 + 6000.0', 4)} AS samp, {cut_sql(f'(({poly(RPC['line_num'])}) / ({poly(RPC['line_den'])})) * 5000.0 + 5000.0', 4)} AS line FROM ({PTS})"


def rsm_poly_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.array(*(F.lit(round(((5 * i) % 7 - 3) / 10, 3)) for i in range(12)))
    value = P.rsm(c, 2, 1, 1, F.col("lon_deg") / 180, F.col("lat_deg") / 80, F.col("elev") / 9000)
    low = P.low_order(c, F.col("lon_deg") / 180, F.col("lat_deg") / 80, F.col("elev") / 9000)
    return pts(spark, sf_dir).select("o_orderkey", cut(value).alias("value"), cut(low).alias("low"))


def _rsm_sql() -> str:
    x, y, z = "(lon_deg / 180)", "(lat_deg / 80)", "(elev / 9000)"
    c = [round(((5 * i) % 7 - 3) / 10, 3) for i in range(12)]
    text = lambda powers: " + ".join(f"({v!r}::DOUBLE)" + "".join(f" * {n}" for n, k in zip((x, y, z), t, strict=True) for _ in range(k)) for v, t in zip(c, powers, strict=False))
    powers = [(i, j, k) for k in range(2) for j in range(2) for i in range(3)]
    return f"SELECT o_orderkey, {cut_sql(text(powers))} AS value, {cut_sql(text(P.LOW_ORDER_TERMS))} AS low FROM ({PTS})"


def rsm_section_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = {"min_row": F.lit(0.0), "row_size": F.lit(40.0), "n_rows": F.lit(4), "min_col": F.lit(0.0), "col_size": F.lit(60.0), "n_cols": F.lit(5)}
    row, col = models.section_index(F.col("lat_deg") + 80, F.col("lon_deg") + 180, p.__getitem__)
    rows = pts(spark, sf_dir).withColumns({"section_row": row, "section_col": col})
    sections = spark.range(20).select((F.col("id") / 5).cast("int").alias("section_row"), (F.col("id") % 5).cast("int").alias("section_col"), (F.col("id") * 10.0).alias("shift"))
    got = rows.join(sections, ["section_row", "section_col"])
    return got.groupBy("section_row", "section_col").agg(F.count("*").alias("n"), F.sum(F.col("elev") + F.col("shift")).alias("total"))


#: A replacement model of two by two sections, whose polynomials meet at the equator and the prime meridian: powers and coefficients by section.
RSM_POWERS = {"rn": (1, 1, 1), "rd": (0, 0, 1), "cn": (1, 2, 0), "cd": (0, 1, 1)}
RSM_SCALES = {"x": 3.2, "y": 1.4, "z": 9000.0}


def _rsm_polys(row: int, col: int) -> dict[str, list[float]]:
    s = 2 * row + col
    return {"rn": [0.0, 0.0, -1.0, 0.01 * (s + 1), 0.0, 0.0, 0.02 * (s + 1), 0.0], "rd": [1.0, 0.03 * (s + 1)], "cn": [0.0, 1.0, 0.0, 0.02 * (s + 1), 0.0, 0.01 * (s + 1)], "cd": [1.0, 0.01 * (s + 1), 0.02, 0.0]}


def _rsm_xml() -> str:
    f = lambda name, value: f'<field name="{name}" value="{value!r}"/>'.replace("'", "")
    corners = [(x, y, z) for z in (0.0, 9000.0) for y in (-1.4, 1.4) for x in (-3.2, 3.2)]
    ida = "".join(f(f"V{i + 1}{a}", v) for i, corner in enumerate(corners) for a, v in zip("XYZ", corner, strict=True)) + "".join(f(n, v) for n, v in (("GRNDD", "G"), ("MINR", 0), ("MAXR", 9999), ("MINC", 0), ("MAXC", 11999)))
    low = {"R": {"0": 5000.0, "Y": -5000.0 / 1.4}, "C": {"0": 6000.0, "X": 6000.0 / 3.2}}
    pia = "".join(f(k + t, low[k].get(t, 0.0)) for k in "RC" for t in ("0", "X", "Y", "Z", "XX", "XY", "XZ", "YY", "YZ", "ZZ")) + "".join(f(n, v) for n, v in (("RNIS", 2), ("CNIS", 2), ("RSSIZ", 5000.0), ("CSSIZ", 6000.0)))
    text = f'<tre name="RSMIDA">{ida}</tre><tre name="RSMPIA">{pia}</tre>'
    for row in range(2):
        for col in range(2):
            norms = {"RNRMO": 5000.0, "RNRMSF": 5000.0, "CNRMO": 6000.0, "CNRMSF": 6000.0, **{f"{a.upper()}NRMO": 0.0 for a in "xyz"}, **{f"{a.upper()}NRMSF": v for a, v in RSM_SCALES.items()}}
            body = f("RSN", row + 1) + f("CSN", col + 1) + "".join(f(n, v) for n, v in norms.items())
            for k, c in _rsm_polys(row, col).items():
                body += "".join(f(f"{k.upper()}PWR{a}", v) for a, v in zip("XYZ", RSM_POWERS[k], strict=True))
                body += f'<repeated name="{k.upper()}PCF" number="{len(c)}">' + "".join(f'<group index="{i}">{f(k.upper() + "PCF", v)}</group>' for i, v in enumerate(c)) + "</repeated>"
            text += f'<tre name="RSMPCA">{body}</tre>'
    return f"<tres>{text}</tres>"


def _rsm_places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Places in the image by the model of their section, and the models, read from the image's records."""
    images = spark.createDataFrame([(0, _rsm_xml())], "image_id int, xml string")
    models_ = models.rsm_models(tre.rsm_parameters(images), tre.rsm_sections(images)).cache()  # a row per section, used by every join
    return models.rsm_world_to_image(dealt(pts(spark, sf_dir)).withColumns({"image_id": F.lit(0), "height": F.col("elev")}), models_), models_


def rsm_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _rsm_places(spark, sf_dir)
    return rows.select("o_orderkey", cut(F.col("x"), 4).alias("samp"), cut(F.col("y"), 4).alias("line"))


def rsm_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, models_ = _rsm_places(spark, sf_dir)
    got = models.rsm_image_to_world(rows.drop("lon_deg", "lat_deg"), models_)
    lon = cut(F.col("lon_deg"), 5)
    return got.select("o_orderkey", F.when(lon == 180, F.lit(-180.0)).otherwise(lon).alias("lon"), cut(F.col("lat_deg"), 5).alias("lat"), (F.col("residual") < 1e-3).alias("close"))


def _rsm_forward_sql() -> str:
    n = (f"({LON} / 3.2::DOUBLE)", f"({LAT} / 1.4::DOUBLE)", "(elev / 9000.0::DOUBLE)")

    def poly(k: str, row: int, col: int) -> str:
        a, b, c = RSM_POWERS[k]
        powers = [(i, j, m) for m in range(c + 1) for j in range(b + 1) for i in range(a + 1)]
        return "(" + " + ".join(f"({v!r}::DOUBLE)" + "".join(f" * {x}" for x, p in zip(n, t, strict=True) for _ in range(p)) for v, t in zip(_rsm_polys(row, col)[k], powers, strict=True)) + ")"

    at = lambda num, den, off: "CASE " + " ".join(f"WHEN lat_deg {'>' if not row else '<='} 0 AND lon_deg {'<' if not col else '>='} 0 THEN {poly(num, row, col)} / {poly(den, row, col)} * {off} + {off}" for row in range(2) for col in range(2)) + " END"
    return f"SELECT o_orderkey, {cut_sql(at('cn', 'cd', '6000.0::DOUBLE'), 4)} AS samp, {cut_sql(at('rn', 'rd', '5000.0::DOUBLE'), 4)} AS line FROM ({PTS})"


def model_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*(F.lit(k) for k in ("AFFINE", "GCP", "CSCRNA", "RPC", "RSM", "SICD", "SIDD")))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("image_id"), kinds[((F.col("l_partkey") + F.col("l_suppkey")) % 7).cast("int")].alias("kind"))
    return models.choose_models(rows)


def _precedence_sql() -> str:
    rank = lambda ks: "max(CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(ks)) + " END)"
    name = lambda c, ks: f"CASE {c} " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(ks)) + " END"
    a, p = models.APPROXIMATE, models.PRECISE
    return f"""SELECT image_id, {name('ra', a)} AS approximate, {name('rp', p)} AS precise, CASE WHEN ra IS NOT NULL AND rp IS NOT NULL THEN 'COMPOSITE' ELSE coalesce({name('rp', p)}, {name('ra', a)}) END AS model
FROM (SELECT image_id, {rank(a)} AS ra, {rank(p)} AS rp FROM (SELECT l_orderkey AS image_id, ['AFFINE','GCP','CSCRNA','RPC','RSM','SICD','SIDD'][(l_partkey + l_suppkey) % 7 + 1] AS kind FROM lineitem) GROUP BY image_id)"""


ECEF_SQL = f"SELECT *, {WGS['a']} / sqrt(1 - {WGS['e2']} * sin({LAT}) * sin({LAT})) AS nn FROM ({PTS})"
_row4, _col4 = _tile_sql(4)
_row8, _col8 = _tile_sql(8)
_row10, _col10 = _tile_sql(10)
_res10 = f"(2 * pi() * {R} / 256 / 1024.0::DOUBLE)"
_b = lambda n, k: f"(({n} + {k}) * 256 * {_res10} - pi() * {R}) / {R}"
_A = [f"({h!r}::DOUBLE)" for h in H]
_w = f"(1 + {_A[6]} * lon_deg + {_A[7]} * lat_deg)"
_fmod = lambda x, m: f"(({x}) - ({m}) * floor(({x}) / ({m})))"
_dms = lambda v, d, w, pos, neg: (
    f"lpad(CAST(CAST({v}_d AS BIGINT) AS VARCHAR), {w}, '0') || lpad(CAST(CAST({v}_m AS BIGINT) AS VARCHAR), 2, '0') || lpad(CAST(CAST({v}_s AS BIGINT) AS VARCHAR), 2, '0') || CASE WHEN {v} < 0 THEN '{neg}' ELSE '{pos}' END"
)
_chip = lambda ul, ur, lr, ll: f"{ul} + u * ({ll} - {ul}) + v * ({ur} - {ul}) + u * v * ({ul} + {lr} - {ur} - {ll})"

QUERIES = {
    f.__name__: f
    for f in (
        wmq_tile_counts, wmq_tile_bounds, wmq_area_limits, lla_to_ecef, ecef_to_lla, normalize_lonlat, range_adjust, dms_format, srtm_tile_id, generic_tile_id, affine_roundtrip, homography_forward,
        homography_inverse, homography_fit, chip_to_full, rpc_forward, rpc_inverse_newton, rpc_terrain, composite_locate, rsm_poly_eval, rsm_section_lookup, rsm_forward, rsm_inverse, model_precedence,
    )
}

ORACLES = {
    "wmq_tile_counts": f"SELECT {_row4} AS tile_row, {_col4} AS tile_col, count(*) AS n, min(elev) AS min_elev, max(elev) AS max_elev FROM ({PTS}) GROUP BY 1, 2",
    "wmq_tile_bounds": f"SELECT tile_row, tile_col, {cut_sql(_b('tile_col', 0), 9)} AS west, {cut_sql(f'atan(sinh({_b("tile_row", 0)}))', 9)} AS south, {cut_sql(_b('tile_col', 1), 9)} AS east, {cut_sql(f'atan(sinh({_b("tile_row", 1)}))', 9)} AS north FROM (SELECT DISTINCT {_row10} AS tile_row, {_col10} AS tile_col FROM ({PTS}))",
    "wmq_area_limits": f"SELECT area, min(r) AS min_row, max(r) AS max_row, min(c) AS min_col, max(c) AS max_col FROM (SELECT o_custkey % 50 AS area, {_row8} AS r, {_col8} AS c FROM ({PTS})) GROUP BY area",
    "lla_to_ecef": f"SELECT o_orderkey, {cut_sql(f'(nn + elev) * cos({LAT}) * cos({LON})', 4)} AS x, {cut_sql(f'(nn + elev) * cos({LAT}) * sin({LON})', 4)} AS y, {cut_sql(f'(nn * (1 - {WGS["e2"]}) + elev) * sin({LAT})', 4)} AS z FROM ({ECEF_SQL})",
    "ecef_to_lla": f"SELECT o_orderkey, {cut_sql('lon_deg')} AS lon_back, {cut_sql('lat_deg')} AS lat_back, {cut_sql('elev', 3)} AS elev_back FROM ({PTS})",
    "normalize_lonlat": f"""SELECT o_orderkey, {cut_sql(_fmod('lon + CASE WHEN abs(lat) > 90 THEN 180 ELSE 0 END + 180', '360') + ' - 180')} AS lon_n, {cut_sql('CASE WHEN abs(lat) > 90 THEN sign(lat) * 180 - lat ELSE lat END')} AS lat_n
FROM (SELECT o_orderkey, lon_deg * 3 + 0.25 AS lon, {_fmod('lat_deg * 3 + 0.25 + 180', '360')} - 180 AS lat FROM ({PTS}))""",
    "range_adjust": f"SELECT o_orderkey, {cut_sql('lon_deg + ceil((360 - lon_deg) / 360) * 360')} AS lon_r, {cut_sql('lat_deg')} AS lat_r FROM ({PTS})",
    "dms_format": f"""SELECT o_orderkey, {_dms('lat_deg', '', 2, 'N', 'S')} || {_dms('lon_deg', '', 3, 'E', 'W')} AS dms FROM (
SELECT *, trunc(round(abs(lat_deg) - lat_deg_d - lat_deg_m / 60.0::DOUBLE, 6) * 3600) AS lat_deg_s, trunc(round(abs(lon_deg) - lon_deg_d - lon_deg_m / 60.0::DOUBLE, 6) * 3600) AS lon_deg_s FROM (
SELECT *, trunc(round(abs(lat_deg) - lat_deg_d, 6) * 60) AS lat_deg_m, trunc(round(abs(lon_deg) - lon_deg_d, 6) * 60) AS lon_deg_m FROM (
SELECT *, floor(round(abs(lat_deg), 6)) AS lat_deg_d, floor(round(abs(lon_deg), 6)) AS lon_deg_d FROM ({PTS}))))""",
    "srtm_tile_id": f"SELECT o_orderkey, CASE WHEN floor(lat_deg) BETWEEN -56 AND 59 THEN CASE WHEN floor(lat_deg) < 0 THEN 's' ELSE 'n' END || lpad(CAST(CAST(abs(floor(lat_deg)) AS BIGINT) AS VARCHAR), 2, '0') || '_' || CASE WHEN floor(lon_deg) < 0 THEN 'w' ELSE 'e' END || lpad(CAST(CAST(abs(floor(lon_deg)) AS BIGINT) AS VARCHAR), 3, '0') || '_1arc_v3.tif' END AS tile_id FROM ({PTS})",
    "generic_tile_id": f"SELECT o_orderkey, CASE WHEN floor(lat_deg) BETWEEN -60 AND 60 AND floor(lon_deg) BETWEEN -120 AND 120 THEN 'dted/' || CASE WHEN floor(lon_deg) < 0 THEN 'w' ELSE 'e' END || lpad(CAST(CAST(abs(floor(lon_deg)) AS BIGINT) AS VARCHAR), 3, '0') || '/' || CASE WHEN floor(lat_deg) < 0 THEN 's' ELSE 'n' END || lpad(CAST(CAST(abs(floor(lat_deg)) AS BIGINT) AS VARCHAR), 2, '0') || '.dt2' END AS tile_id FROM ({PTS})",
    "affine_roundtrip": f"""SELECT o_orderkey, {cut_sql('(g5 * (lon_deg - g0) - g2 * (lat_deg - g3)) / (g1 * g5 - g2 * g4)', 4)} AS px, {cut_sql('(g1 * (lat_deg - g3) - g4 * (lon_deg - g0)) / (g1 * g5 - g2 * g4)', 4)} AS py, {cut_sql('lon_deg')} AS lon_back, {cut_sql('lat_deg')} AS lat_back
FROM (SELECT *, -180.0::DOUBLE AS g0, 0.01::DOUBLE AS g1, 0.001::DOUBLE AS g2, 80.0::DOUBLE AS g3, 0.0005::DOUBLE AS g4, -0.01::DOUBLE AS g5 FROM ({PTS}))""",
    "homography_forward": f"SELECT o_orderkey, {cut_sql(f'({_A[0]} + {_A[1]} * lon_deg + {_A[2]} * lat_deg) / {_w}', 5)} AS u, {cut_sql(f'({_A[3]} + {_A[4]} * lon_deg + {_A[5]} * lat_deg) / {_w}', 5)} AS v FROM ({PTS})",
    "homography_inverse": f"SELECT o_orderkey, {cut_sql('lon_deg', 5)} AS x, {cut_sql('lat_deg', 5)} AS y FROM ({PTS})",
    "homography_fit": f"SELECT image, {', '.join(f'{cut_sql(_A[i], 4)} AS h{i}' for i in range(8))} FROM (SELECT o_custkey % 20 AS image FROM orders GROUP BY 1 HAVING count(*) >= 4)",
    "chip_to_full": f"SELECT o_orderkey, {cut_sql(_chip('100.0::DOUBLE', '1123.0::DOUBLE', '1100.0::DOUBLE', '90.0::DOUBLE'), 5)} AS full_x, {cut_sql(_chip('50.0::DOUBLE', '60.0::DOUBLE', '1080.0::DOUBLE', '1070.0::DOUBLE'), 5)} AS full_y FROM (SELECT o_orderkey, (o_custkey % 512) / 511.0::DOUBLE AS u, (o_orderkey % 512) / 511.0::DOUBLE AS v FROM orders)",
    "rpc_forward": _rpc_sql(),
    "rpc_inverse_newton": f"SELECT o_orderkey, {cut_sql('lon_deg', 5)} AS lon, {cut_sql('lat_deg', 5)} AS lat, true AS close FROM ({PTS})",
    "rpc_terrain": f"SELECT o_orderkey, {cut_sql('lon_deg', 4)} AS lon, {cut_sql('lat_deg', 4)} AS lat, {cut_sql('3000.0002::DOUBLE + 2.0::DOUBLE * lon_deg + 5.0::DOUBLE * lat_deg', 2)} AS height FROM ({PTS})",
    "composite_locate": f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN {cut_sql('lon_deg', 5)} END AS lon, CASE WHEN o_orderkey % 4 > 0 THEN {cut_sql('lat_deg', 5)} END AS lat, CASE WHEN o_orderkey % 4 = 0 THEN true END AS plate FROM ({PTS})",
    "rsm_poly_eval": _rsm_sql(),
    "rsm_section_lookup": f"SELECT section_row, section_col, count(*) AS n, sum(elev + (section_row * 5 + section_col) * 10.0::DOUBLE) AS total FROM (SELECT CAST(greatest(0, least(floor((lat_deg + 80) / 40.0), 3)) AS INTEGER) AS section_row, CAST(greatest(0, least(floor((lon_deg + 180) / 60.0), 4)) AS INTEGER) AS section_col, elev FROM ({PTS})) GROUP BY 1, 2",
    "rsm_forward": _rsm_forward_sql(),
    "rsm_inverse": f"SELECT o_orderkey, {cut_sql('lon_deg', 5)} AS lon, {cut_sql('lat_deg', 5)} AS lat, true AS close FROM ({PTS})",
    "model_precedence": _precedence_sql(),
}
