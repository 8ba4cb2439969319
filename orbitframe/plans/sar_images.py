"""SAR products from their documents to the ground and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.functions import geodesy as G
from orbitframe.operators import sar, terrain
from orbitframe.plans import imagery as I
from orbitframe.plans.relations import cut, cut_sql
from orbitframe.sources import products

#: Pixel of the centre point; a pixel is a metre.
SCP_ROW, SCP_COL = 1000.0, 800.0
#: Size of the chip of the derived product, and where its corner lies in the full image; it is scaled by two.
CHIP, CHIP_AT = 512.0, 300.0
GROUND = (1.0, 0.0, 0.0)


def _vector(tag: str, v, prefix: str = "") -> str:
    return f"<{tag}>" + "".join(f"<{prefix}{a}>{x!r}</{prefix}{a}>" for a, x in zip("XYZ", v, strict=True)) + f"</{tag}>"


def _line(tag: str, c, prefix: str = "") -> str:
    return f'<{tag} order1="{len(c) - 1}">' + "".join(f'<{prefix}Coef exponent1="{i}">{x!r}</{prefix}Coef>' for i, x in enumerate(c)) + f"</{tag}>"


def _surface(tag: str, c, prefix: str = "") -> str:
    cells = "".join(f'<{prefix}Coef exponent1="{i}" exponent2="{j}">{x!r}</{prefix}Coef>' for i, row in enumerate(c) for j, x in enumerate(row) if x)
    return f'<{tag} order1="{len(c) - 1}" order2="{len(c[0]) - 1}">{cells}</{tag}>'


#: Rows of the plane product lie across the others' ranges; a metre of azimuth is a metre along the track.
SLANT_ROW = (-0.6, 0.0, -0.8)
TIME, POLAR, FACTOR, RATE, TIME_CA, AZ_FACTOR = [[0.01, 1e-5]], [0.0, -0.01], [1.0, 0.002], [[1.0, 1e-7], [2e-7, 0.0]], [0.005, 1.43e-4], 1.4e-6


def sicd_xml(kind: str, first: tuple[int, int] = (0, 0)) -> str:
    """A document of the straight pass of the other queries, by kind of projection."""
    grid = {"PLANE": "PLANE", "PFA": "RGAZIM", "RGAZCOMP": "RGAZIM", "INCA": "RGZERO"}[kind]
    formed = {
        "PLANE": "", "PFA": f"<PFA>{_vector('FPN', GROUND)}{_line('PolarAngPoly', POLAR)}{_line('SpatialFreqSFPoly', FACTOR)}</PFA>", "RGAZCOMP": "<RgAzComp><AzSF>1.4e-6</AzSF></RgAzComp>",
        "INCA": f"<RMA><INCA>{_line('TimeCAPoly', TIME_CA)}<R_CA_SCP>700071.0</R_CA_SCP>{_surface('DRateSFPoly', RATE)}</INCA></RMA>",
    }[kind]
    track = "".join(_line(a, c) for a, c in zip("XYZ", I.ARP, strict=True))
    at = [c[0] + 0.01 * (c[1] if len(c) > 1 else 0.0) for c in I.ARP]
    speed = [c[1] if len(c) > 1 else 0.0 for c in I.ARP]
    return (
        f'<?xml version="1.0"?><SICD xmlns="urn:SICD:1.2.1"><ImageFormation><ImageFormAlgo>{kind}</ImageFormAlgo></ImageFormation><GeoData><SCP>{_vector("ECF", I.SCP)}</SCP></GeoData>'
        f"<ImageData><NumRows>2000</NumRows><NumCols>1600</NumCols><FirstRow>{first[0]}</FirstRow><FirstCol>{first[1]}</FirstCol><SCPPixel><Row>{SCP_ROW}</Row><Col>{SCP_COL}</Col></SCPPixel></ImageData>"
        f"<Grid><Type>{grid}</Type>{_surface('TimeCOAPoly', TIME)}<Row>{_vector('UVectECF', I.U_ROW if kind == 'PLANE' else SLANT_ROW)}<SS>1.0</SS></Row><Col>{_vector('UVectECF', I.U_COL)}<SS>1.0</SS></Col></Grid>"
        f"<Position><ARPPoly>{track}</ARPPoly></Position><SCPCOA>{_vector('ARPPos', at)}{_vector('ARPVel', speed)}<SideOfTrack>R</SideOfTrack></SCPCOA>{formed}</SICD>"
    )


def sidd_xml(chip: bool = True) -> str:
    """A derived product of the same pass, with prefixed tags."""
    point = lambda tag, row, col: f"<{tag}><si:Row>{row!r}</si:Row><si:Col>{col!r}</si:Col></{tag}>"
    low, high = CHIP_AT, CHIP_AT + 2 * CHIP
    cut_ = "" if not chip else "<DownstreamReprocessing><GeometricChip>" + point("ChipSize", CHIP, CHIP) + "".join(point(f"Original{n}Coordinate", r, c) for n, r, c in (("UpperLeft", low, low), ("UpperRight", low, high), ("LowerLeft", high, low), ("LowerRight", high, high))) + "</GeometricChip></DownstreamReprocessing>"
    track = "".join(_line(f"si:{a}", c, "si:") for a, c in zip("XYZ", I.ARP, strict=True))
    return (
        f'<SIDD xmlns="urn:SIDD:2.0.0" xmlns:si="urn:SICommon:1.0"><Measurement><PlaneProjection><ReferencePoint>{_vector("si:ECEF", I.SCP, "si:")}{point("si:Point", SCP_ROW, SCP_COL)}</ReferencePoint>'
        f"{point('SampleSpacing', 1.0, 1.0)}{_surface('TimeCOAPoly', TIME, 'si:')}<ProductPlane>{_vector('RowUnitVector', I.U_ROW, 'si:')}{_vector('ColUnitVector', I.U_COL, 'si:')}</ProductPlane></PlaneProjection>"
        f"{point('PixelFootprint', 2000, 1600)}<ARPPoly>{track}</ARPPoly></Measurement><ExploitationFeatures></ExploitationFeatures>{cut_}</SIDD>"
    )


KINDS = ["PLANE", "PFA", "RGAZCOMP", "INCA"]


def _images(spark: SparkSession) -> DataFrame:
    docs = spark.createDataFrame([(i, sicd_xml(k)) for i, k in enumerate(KINDS)], "image_id long, xml string")
    return products.sicd(docs)


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    y, x = (F.col("o_orderkey") * 7919 % 2000).cast("double"), (F.col("o_custkey") * 3571 % 1600).cast("double")
    return rows.select("o_orderkey", (F.col("o_orderkey") % 4).alias("image_id"), x.alias("x"), y.alias("y"))


def sicd_image_to_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of four complex products, one per kind of projection, on the ground plane."""
    got = sar.image_to_world(_pixels(spark, sf_dir), _images(spark))
    return got.select("o_orderkey", *(cut(F.col("place")[a], 2).alias(a) for a in "xyz"))


def sicd_world_to_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same places back in their images."""
    got = sar.image_to_world(_pixels(spark, sf_dir), _images(spark)).drop("x", "y", "place")
    back = sar.world_to_image(got, _images(spark))
    return back.select("o_orderkey", F.floor(F.col("x") + 0.5).alias("x"), F.floor(F.col("y") + 0.5).alias("y"), (F.col("miss") < 0.01).alias("close"))


def sidd_chip_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of a chip of a derived product on its product plane."""
    params = products.with_chips(products.sidd(spark.createDataFrame([(0, sidd_xml())], "image_id int, xml string")))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.lit(0).alias("image_id"), (F.col("o_custkey") * 3571 % 512).cast("double").alias("x"), (F.col("o_orderkey") * 7919 % 512).cast("double").alias("y"))
    got = sar.image_to_world(rows, params)
    return got.select("o_orderkey", *(cut(F.col("place")[a], 2).alias(a) for a in "xyz"))


#: A plane in longitude and latitude, which posts give back between them: height at the centre, metres a degree east and north.
SLOPE = (120.0, 800.0, -600.0)
POSTS, SPACING = 61, 0.002


def terrain_tiles(spark: SparkSession) -> DataFrame:
    """Four elevation tiles that meet at the centre, whose posts rise to the east and fall to the north."""
    first = -(POSTS - 1) * SPACING
    k = F.col("id")
    west, north = first * (1 - k % 2), -first * F.floor(k / 2)
    z = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(POSTS - 1)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(POSTS - 1)), lambda c: SLOPE[0] + SLOPE[1] * (west + c * SPACING) + SLOPE[2] * (north - r * SPACING))))
    gt = F.array(west, F.lit(SPACING), F.lit(0.0), north, F.lit(0.0), F.lit(-SPACING))
    return spark.range(4).select(k.cast("string").alias("tile_id"), F.lit(POSTS).alias("width"), F.lit(POSTS).alias("height"), gt.alias("gt"), z.alias("z"), F.lit(-9999.0).alias("no_data"))


def tile_of(lon: Column, lat: Column) -> Column:
    return F.concat((F.when(lon >= 0, 1).otherwise(0) + F.when(lat > 0, 2).otherwise(0)).cast("string"))


def sar_terrain_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the four products where their contours meet a sloping terrain of four tiles."""
    got = terrain.image_to_tiles(_pixels(spark, sf_dir), _images(spark), "o_orderkey", terrain_tiles(spark), tile_of, F.lit(60.0), F.lit(200.0))
    return got.select("o_orderkey", *(cut(F.col("place")[a], 2).alias(a) for a in "xyz"), cut(F.col("height"), 2).alias("height"))


# The ground plane through the centre point has the normal (1, 0, 0): a height of 500 km, and velocities lie in it.
_KIND_SQL = {
    0: f"SELECT o_orderkey, py, pz, vy, vz, r, rdot FROM {I._UNI}",
    1: f"SELECT o_orderkey, py, pz, vy, vz, r0 + k * al AS r, d0 + (0.002::DOUBLE * al + k * ac) * -0.01::DOUBLE AS rdot FROM (SELECT *, 1 + 0.002::DOUBLE * th AS k, rg * cos(th) + az * sin(th) AS al, az * cos(th) - rg * sin(th) AS ac FROM (SELECT *, -0.01::DOUBLE * t AS th FROM {I._TO_SCP}))",
    2: f"SELECT o_orderkey, py, pz, vy, vz, r0 + rg AS r, d0 - sqrt(vy * vy + vz * vz) * 1.4e-6::DOUBLE * az AS rdot FROM {I._TO_SCP}",
    3: f"SELECT o_orderkey, py, pz, vy, vz, r, f / r * {I._V2} * dt AS rdot FROM (SELECT *, sqrt((700071.0::DOUBLE + rg) * (700071.0::DOUBLE + rg) + f * {I._V2} * dt * dt) AS r FROM (SELECT *, t - (0.005::DOUBLE + 1.43e-4::DOUBLE * az) AS dt, 1 + 1e-7 * az + 2e-7 * rg AS f FROM {I._SAR}))",
}
_CONTOURS = " UNION ALL ".join(f"(SELECT * FROM ({q}) WHERE o_orderkey % 4 = {k})" for k, q in _KIND_SQL.items())
def ground_sql(contours: str) -> str:
    """x, y and z where contours meet the ground plane."""
    return (
        "SELECT o_orderkey, 6378137.0::DOUBLE AS x, py + g * (c * uy - s * uz) AS y, pz + g * (c * uz + s * uy) AS z FROM (SELECT *, -rdot / (v * g / r) AS c, sign(py * vz - pz * vy) * sqrt(1 - (rdot / (v * g / r)) * (rdot / (v * g / r))) AS s FROM ("
        f"SELECT *, sqrt(r * r - 250000000000.0::DOUBLE) AS g, sqrt(vy * vy + vz * vz) AS v, vy / sqrt(vy * vy + vz * vz) AS uy, vz / sqrt(vy * vy + vz * vz) AS uz FROM ({contours})))"
    )


def cut_places(places: str) -> str:
    return f"SELECT o_orderkey, {', '.join(f'{cut_sql(a, 2)} AS {a}' for a in 'xyz')} FROM ({places})"


_GROUND = cut_places(ground_sql(_CONTOURS))
# The chip is scaled by two; the product plane has the normal n = (0.8, 0, 0.6).
_CHIP = f"(SELECT o_orderkey, {CHIP_AT}::DOUBLE + 2 * (o_orderkey * 7919 % 512) - {SCP_ROW}::DOUBLE AS rg, {CHIP_AT}::DOUBLE + 2 * (o_custkey * 3571 % 512) - {SCP_COL}::DOUBLE AS az FROM orders)"
_CHIP = f"(SELECT *, 500000.0::DOUBLE AS dx, -100 + 7000 * t AS dy, 490000 + 20 * t AS dz, 7000.0::DOUBLE AS vy, 20.0::DOUBLE AS vz FROM (SELECT *, 0.01::DOUBLE + az * 1e-5 AS t FROM {_CHIP}))"
_CHIP = f"(SELECT *, sqrt(lx * lx + ly * ly + lz * lz) AS r, (vy * ly + vz * lz) / sqrt(lx * lx + ly * ly + lz * lz) AS rdot, 0.8::DOUBLE * dx + 0.6::DOUBLE * dz AS h, 0.6::DOUBLE * vz AS wz, sqrt(vy * vy + vz * vz - 0.36::DOUBLE * vz * vz) AS wx FROM (SELECT *, dx + 0.6::DOUBLE * rg AS lx, dy - az AS ly, dz - 0.8::DOUBLE * rg AS lz FROM {_CHIP}))"
_CHIP = f"(SELECT *, sqrt(r * r - h * h) AS g, -0.8::DOUBLE * wz / wx AS ex, vy / wx AS ey, (vz - 0.6::DOUBLE * wz) / wx AS ez, 0.8::DOUBLE * (dy * vz - dz * vy) + 0.6::DOUBLE * (dx * vy) AS look FROM {_CHIP})"
_CHIP = f"(SELECT *, (wz * h / r - rdot) / (wx * g / r) AS c FROM {_CHIP})"
_CHIP = f"(SELECT *, sign(look) * sqrt(1 - c * c) AS s FROM {_CHIP})"
CHIP_PLACES = f"SELECT o_orderkey, 6378137.0::DOUBLE + dx - 0.8::DOUBLE * h + g * (c * ex + s * (0 - 0.6::DOUBLE * ey)) AS x, dy + g * (c * ey + s * (0.6::DOUBLE * ex - 0.8::DOUBLE * ez)) AS y, dz - 0.6::DOUBLE * h + g * (c * ez + s * (0.8::DOUBLE * ey)) AS z FROM {_CHIP}"
_CHIP = cut_places(CHIP_PLACES)



def _terrain_sql() -> str:
    """The contour's circle around the track, and secant steps on the height above the terrain along it."""
    a, f = "6378137.0::DOUBLE", 1 / 298.257223563
    e2, minor = f * (2 - f), 6378137.0 * (1 - f)

    def above(rows: str, angle: str, out: str) -> str:
        """Adds the place at an angle and its height above the terrain."""
        rows = f"SELECT *, 6878137.0::DOUBLE - rho * cos({angle}) AS {out}x, py + along * vy / v + rho * sin({angle}) * vz / v AS {out}y, pz + along * vz / v - rho * sin({angle}) * vy / v AS {out}z FROM ({rows})"
        rows = f"SELECT *, sqrt({out}x * {out}x + {out}y * {out}y) AS {out}p, atan2({a} * {out}z, {minor!r}::DOUBLE * sqrt({out}x * {out}x + {out}y * {out}y)) AS {out}b0 FROM ({rows})"
        for i in range(2):
            rows = f"SELECT *, atan2({out}z + {e2 / (1 - e2) * minor!r}::DOUBLE * sin({out}b{i}) * sin({out}b{i}) * sin({out}b{i}), {out}p - {e2 * 6378137.0!r}::DOUBLE * cos({out}b{i}) * cos({out}b{i}) * cos({out}b{i})) AS {out}f{i} FROM ({rows})"
            rows = f"SELECT *, atan2({1 - f!r}::DOUBLE * sin({out}f{i}), cos({out}f{i})) AS {out}b{i + 1} FROM ({rows})"
        rows = f"SELECT *, {out}p * cos({out}f1) + {out}z * sin({out}f1) - {a} * sqrt(1 - {e2!r}::DOUBLE * sin({out}f1) * sin({out}f1)) AS {out}h FROM ({rows})"
        return f"SELECT *, {out}h - ({SLOPE[0]}::DOUBLE + {SLOPE[1]}::DOUBLE * degrees(atan2({out}y, {out}x)) + ({SLOPE[2]}::DOUBLE) * degrees({out}f1)) AS {out}d FROM ({rows})"

    keep = "o_orderkey, py, pz, vy, vz, v, along, rho"
    # v . (position - place) = r rdot
    rows = f"SELECT *, sqrt(vy * vy + vz * vz) AS v, -r * rdot / sqrt(vy * vy + vz * vz) AS along FROM ({_CONTOURS})"
    rows = f"SELECT *, sqrt(r * r - along * along) AS rho FROM ({rows})"
    # the circle's axes are down and across the track to the right, where the centre point lies; it is level with it at 500 km below
    rows = f"SELECT *, sign(pz * vy - py * vz) AS look FROM ({rows})"
    rows = f"SELECT *, look * acos((500000.0::DOUBLE - 120) / rho) AS t0, look * acos((500000.0::DOUBLE - 160) / rho) AS t1 FROM ({rows})"
    for _ in range(4):
        rows = above(above(f"SELECT {keep}, t0, t1 FROM ({rows})", "t0", "l"), "t1", "m")
        rows = f"SELECT {keep}, t1 AS t0, CASE WHEN md = ld THEN t1 ELSE t1 - md * (t1 - t0) / (md - ld) END AS t1 FROM ({rows})"
    rows = above(rows, "t1", "n")
    return f"SELECT o_orderkey, {cut_sql('nx', 2)} AS x, {cut_sql('ny', 2)} AS y, {cut_sql('nz', 2)} AS z, {cut_sql('nh', 2)} AS height FROM ({rows})"


QUERIES = {f.__name__: f for f in (sicd_image_to_world, sicd_world_to_image, sidd_chip_locate, sar_terrain_project)}
ORACLES = {
    "sicd_image_to_world": _GROUND,
    "sicd_world_to_image": "SELECT o_orderkey, CAST(o_custkey * 3571 % 1600 AS BIGINT) AS x, CAST(o_orderkey * 7919 % 2000 AS BIGINT) AS y, true AS close FROM orders",
    "sidd_chip_locate": _CHIP,
    "sar_terrain_project": _terrain_sql(),
}
