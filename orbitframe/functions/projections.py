"""Map projections as columns: transverse Mercator, Mercator, polar stereographic and Lambert conformal conic.

All are conformal, so each works from the conformal latitude, kept as its tangent, and the longitude from the central
meridian.  What depends on the reference system alone is worked out once per system (``constants``), so a place costs
the formulas of its own projection.  Angles in radians, lengths in metres.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.functions.geodesy import FLATTENING, A

# Krueger's series in the third flattening n, a row for each sine term, a column for each power of n from the row's own on.
FORWARD = [
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800], [13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360], [61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
    [49561 / 161280, -179 / 168, 6601661 / 7257600], [34729 / 80640, -3418889 / 1995840], [212378941 / 319334400],
]
INVERSE = [
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800], [1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720], [17 / 480, -37 / 840, -209 / 4480, 5569 / 90720],
    [4397 / 161280, -11 / 504, -830251 / 7257600], [4583 / 161280, -108847 / 3991680], [20648693 / 638668800],
]
#: Newton steps from conformal to geodetic latitude; two suffice for the Earth.
STEPS = 3
KINDS = ["GEOGRAPHIC", "TM", "MERCATOR", "SPHERE", "POLAR", "LCC"]
#: Parameters of a system: kind, axis and inverse flattening, origin, scale at the origin, false origin in units, standard parallels, metres of a unit.
PARAMETERS = ["kind", "axis", "flattening", "lon0", "lat0", "scale", "east", "north", "parallel1", "parallel2", "unit"]

Pair = tuple[Column, Column]


def _number(text: Column, *names: str) -> Column:
    """Value of the first parameter of any of the names, in WKT of either version."""
    wanted = "|".join(names)
    found = F.regexp_extract(text, rf'(?i)PARAMETER\s*\[\s*"(?:{wanted})"\s*,\s*([-+0-9.eE]+)', 1)
    return F.when(found != "", found.try_cast("double"))


def parsed(text: Column) -> Column:
    """Struct of PARAMETERS (angles in degrees) of a reference system's text: WKT of version 1 or 2, or an EPSG code.

    Known codes are 4326, 3857, 3395, 5041 and 5042 (polar), 3031, 3413, 3995 and the zones of WGS-84, 32601 to 32660
    and 32701 to 32760.  A null or empty text means longitude and latitude; any other text that is not understood is an
    error.  Datums are not shifted: places are on the system's own ellipsoid.
    """
    code = F.regexp_extract(text, r"(?i)^\s*EPSG:(\d+)\s*$", 1).try_cast("int")
    row = lambda kind, lon0=0.0, lat0=0.0, scale=1.0, east=0.0, north=0.0, p1=None, p2=None, axis=F.lit(A), inverse=F.lit(1 / FLATTENING), unit=1.0: F.struct(
        *(c.cast("string" if n == "kind" else "double").alias(n) for n, c in zip(PARAMETERS, [v if isinstance(v, Column) else F.lit(v) for v in (kind, axis, inverse, lon0, lat0, scale, east, north, p1, p2, unit)], strict=True))
    )
    zone = code % 100
    by_code = (
        F.when(code == 4326, row("GEOGRAPHIC")).when(code == 3857, row("SPHERE")).when(code == 3395, row("MERCATOR"))
        .when(code.between(32601, 32660) | code.between(32701, 32760), row("TM", zone * 6 - 183, 0.0, 0.9996, 500000.0, F.when(code > 32700, 1e7).otherwise(0.0)))
        .when(code == 5041, row("POLAR", 0.0, 90.0, 0.994, 2e6, 2e6)).when(code == 5042, row("POLAR", 0.0, -90.0, 0.994, 2e6, 2e6))
        .when(code == 3031, row("POLAR", 0.0, -90.0, p1=-71.0)).when(code == 3413, row("POLAR", -45.0, 90.0, p1=70.0)).when(code == 3995, row("POLAR", 0.0, 90.0, p1=71.0))
    )
    body = r'(?i)(?:SPHEROID|ELLIPSOID)\s*\[\s*"[^"]*"\s*,\s*([0-9.eE+]+)\s*,\s*([0-9.eE+]+)'
    axis, inverse = (F.regexp_extract(text, body, i).try_cast("double") for i in (1, 2))
    method = F.regexp_replace(F.lower(F.regexp_extract(text, r'(?i)(?:PROJECTION|METHOD)\s*\[\s*"([^"]*)"', 1)), "[^a-z0-9]+", " ")
    units = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r'(?i)UNIT\s*\[\s*"[^"]*"\s*,\s*([0-9.eE+-]+)'), 1), lambda v: v.try_cast("double")), lambda v: F.abs(v - math.pi / 180) > 1e-4)
    unit = F.coalesce(F.try_element_at(units, F.lit(-1)), F.lit(1.0))
    lon0 = F.coalesce(_number(text, "central_meridian", "longitude_of_center", "longitude of natural origin", "longitude of false origin", "longitude of origin", "straight_vertical_longitude_from_pole"), F.lit(0.0))
    lat0 = F.coalesce(_number(text, "latitude_of_origin", "latitude_of_center", "latitude of natural origin", "latitude of false origin"), F.lit(0.0))
    scale = F.coalesce(_number(text, "scale_factor", "scale factor at natural origin"), F.lit(1.0))
    east = F.coalesce(_number(text, "false_easting", "false easting", "easting at false origin"), F.lit(0.0))
    north = F.coalesce(_number(text, "false_northing", "false northing", "northing at false origin"), F.lit(0.0))
    p1 = _number(text, "standard_parallel_1", "latitude of 1st standard parallel", "latitude of standard parallel")
    p2 = _number(text, "standard_parallel_2", "latitude of 2nd standard parallel")
    full = lambda kind, latitude=lat0, first=p1, second=p2, k=scale: row(kind, lon0, latitude, k, east, north, first, second, axis, inverse, unit)
    polar_b = method.rlike("^polar stereographic variant b$")
    old_polar = method == "polar stereographic"  # version 1: the latitude of origin is the standard parallel, unless it is a pole
    pole = lambda latitude: F.when(latitude < 0, -90.0).otherwise(90.0)
    by_text = (
        F.when(method.rlike("^transverse mercator"), full("TM"))
        .when(method.rlike("^(popular visualisation )?pseudo mercator") | (method.rlike("^mercator") & F.lower(text).contains("popular visualisation")), full("SPHERE"))
        .when(method.rlike("^mercator"), full("MERCATOR"))
        .when(polar_b, full("POLAR", pole(p1))).when(old_polar & (F.abs(lat0) < 90), full("POLAR", pole(lat0), lat0)).when(method.rlike("^polar stereographic"), full("POLAR", first=F.lit(None)))
        .when(method.rlike("^lambert conic conformal 2sp|^lambert conformal conic 2sp|^lambert conic conformal 2sp "), full("LCC"))
        .when(method.rlike("^lambert con[a-z]+ con[a-z]+( 1sp)?$"), full("LCC", first=F.coalesce(p1, lat0), second=F.coalesce(p2, p1, lat0)))
        .when((method == "") & text.rlike(r"(?i)^\s*(GEOGCS|GEOGCRS|GEODCRS)\s*\["), full("GEOGRAPHIC"))
    )
    sound = F.coalesce((by_text["axis"] > 0) & (by_text["flattening"] >= 0), F.lit(False))
    unknown = F.raise_error(F.concat(F.lit("unknown reference system: "), F.substring(text, 1, 200)))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", row("GEOGRAPHIC")).when(code.isNotNull(), F.coalesce(by_code, F.when(F.lit(True), unknown.cast(by_code_type())))).when(sound, by_text).otherwise(unknown.cast(by_code_type()))


def by_code_type() -> str:
    return "struct<" + ",".join(f"{n}:{'string' if n == 'kind' else 'double'}" for n in PARAMETERS) + ">"


def _conformal(lat: Column, e: Column) -> Column:
    """Tangent of the conformal latitude."""
    t = F.tan(lat)
    h = F.sqrt(1 + t * t)
    s = F.sinh(e * F.atanh(e * t / h))
    return t * F.sqrt(1 + s * s) - s * h


def constants(systems: DataFrame, text: str = "crs") -> DataFrame:
    """Rows with the struct system: the parameters, in radians and metres, and what the formulas need of them."""
    p = F.col("_p").getField
    rows = systems.withColumn("_p", parsed(F.col(text)))
    f = F.when(p("flattening") > 0, 1 / p("flattening")).otherwise(F.lit(0.0))
    rows = rows.withColumns({"_f": f, "_lat0": F.radians(p("lat0")), "_p1": F.radians(p("parallel1")), "_p2": F.radians(F.coalesce(p("parallel2"), p("parallel1")))})
    rows = rows.withColumns({"_e2": F.col("_f") * (2 - F.col("_f")), "_n": F.col("_f") / (2 - F.col("_f"))})
    rows = rows.withColumn("_e", F.sqrt("_e2"))
    e, n = F.col("_e"), F.col("_n")
    width = lambda v: F.cos(v) / F.sqrt(1 - F.col("_e2") * F.sin(v) * F.sin(v))
    psi = lambda v: F.asinh(_conformal(v, e))

    def series(table: list[list[float]]) -> Column:
        out = []
        for j, row in enumerate(table):
            value = F.lit(0.0)
            for c in row[::-1]:
                value = value * n + c
            out.append(value * F.pow(n, F.lit(j + 1.0)))
        return F.array(*out)

    rectifying = p("axis") / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64 + F.pow(n, F.lit(6.0)) / 256)
    rows = rows.withColumns({"_alpha": series(FORWARD), "_beta": series(INVERSE), "_radius": rectifying * p("scale")})
    rows = rows.withColumn("_xi0", _krueger(F.atan(_conformal(F.col("_lat0"), e)), F.lit(0.0), F.col("_alpha"), 1)[0])
    south = p("lat0") < 0
    at = F.abs("_p1")
    from_scale = 2 * p("scale") / F.sqrt(F.pow(1 + e, 1 + e) * F.pow(1 - e, 1 - e))
    rows = rows.withColumn("_rho", p("axis") * F.when(F.col("_p1").isNull(), from_scale).otherwise(width(at) * F.exp(psi(at))))
    cone = F.when(F.abs(F.col("_p1") - F.col("_p2")) < 1e-10, F.sin("_p1")).otherwise(F.try_divide(F.log(width(F.col("_p1"))) - F.log(width(F.col("_p2"))), psi(F.col("_p2")) - psi(F.col("_p1"))))
    rows = rows.withColumn("_cone", cone)
    rows = rows.withColumn("_big", p("axis") * p("scale") * F.try_divide(width(F.col("_p1")), F.col("_cone")) * F.exp(F.col("_cone") * psi(F.col("_p1"))))
    rows = rows.withColumn("_rho0", F.col("_big") * F.exp(-F.col("_cone") * psi(F.col("_lat0"))))
    system = F.struct(
        p("kind").alias("kind"), e.alias("e"), (p("axis") * p("scale")).alias("axis"), F.radians(p("lon0")).alias("lon0"), p("east").alias("east"), p("north").alias("north"), p("unit").alias("unit"), F.col("_alpha").alias("alpha"), F.col("_beta").alias("beta"),
        F.col("_radius").alias("radius"), F.col("_xi0").alias("xi0"), south.alias("south"), F.col("_rho").alias("rho"), F.col("_cone").alias("cone"), F.col("_big").alias("big"), F.col("_rho0").alias("rho0"),
    )
    return rows.select(*systems.columns, system.alias("system"))


def _krueger(xi: Column, eta: Column, c: Column, sign: int) -> Pair:
    for_xi, for_eta = xi, eta
    for j in range(6):
        k = 2.0 * (j + 1)
        for_xi = for_xi + sign * c[j] * F.sin(k * xi) * F.cosh(k * eta)
        for_eta = for_eta + sign * c[j] * F.cos(k * xi) * F.sinh(k * eta)
    return for_xi, for_eta


def project(df: DataFrame, lon_deg: str, lat_deg: str, system: str = "system", out: tuple[str, str] = ("east", "north")) -> DataFrame:
    """Rows with the projected coordinates of a place, in the system's units; degrees for geographic systems."""
    names = [n for n in df.columns if n not in out]
    found = F.arrow_udf(_projected, "struct<east:double,north:double>").asNondeterministic()
    rows = df.withColumn("_at", found(F.col(lon_deg).cast("double"), F.col(lat_deg).cast("double"), F.col(system)))
    return rows.select(*names, F.col("_at.east").alias(out[0]), F.col("_at.north").alias(out[1]))


def _projected(lon: pa.Array, lat: pa.Array, system: pa.Array) -> pa.Array:
    lon, lat = (v.to_numpy(zero_copy_only=False).astype(float) for v in (lon, lat))
    every, east, north = _system(system), np.full(len(lon), np.nan), np.full(len(lon), np.nan)
    with np.errstate(all="ignore"):
        for kind in KINDS:
            i = np.flatnonzero(every["kind"] == kind)
            s = {n: v[i] for n, v in every.items()}
            if kind == "GEOGRAPHIC":
                east[i], north[i] = lon[i], lat[i]
                continue
            l = np.radians(lon[i]) - s["lon0"]
            l = l - 2 * math.pi * np.floor((l + math.pi) / (2 * math.pi))
            turn = np.where(s["south"] == 1, -1.0, 1.0) if kind == "POLAR" else 1.0
            t, e = np.tan(turn * np.radians(lat[i])), np.zeros(len(i)) if kind == "SPHERE" else s["e"]
            h = np.sqrt(1 + t * t)
            g = np.sinh(e * np.arctanh(e * t / h))
            t = t * np.sqrt(1 + g * g) - g * h
            if kind == "TM":
                c = np.cos(l)
                xi, eta = _series(np.arctan2(t, c), np.arcsinh(np.sin(l) / np.sqrt(t * t + c * c)), s["alpha"], 1)
                x, y = s["radius"] * eta, s["radius"] * (xi - s["xi0"])
            elif kind == "POLAR":
                rho = s["rho"] * np.exp(-np.arcsinh(t))
                x, y = rho * np.sin(l), -turn * rho * np.cos(l)
            elif kind == "LCC":
                arc = s["big"] * np.exp(-s["cone"] * np.arcsinh(t))
                x, y = arc * np.sin(s["cone"] * l), s["rho0"] - arc * np.cos(s["cone"] * l)
            else:
                x, y = s["axis"] * l, s["axis"] * np.arcsinh(t)
            east[i], north[i] = x / s["unit"] + s["east"], y / s["unit"] + s["north"]
    return pa.StructArray.from_arrays([pa.array(v, from_pandas=True) for v in (east, north)], ["east", "north"])


def unproject(df: DataFrame, east: str, north: str, system: str = "system", out: tuple[str, str] = ("lon_deg", "lat_deg"), wrapped: bool = True) -> DataFrame:
    """Rows with longitude and latitude in degrees of projected coordinates; the longitude lies in [-180, 180).

    Not wrapped, the longitude of a projected place is counted from its system's meridian on, so it may pass 180.
    """
    names = [n for n in df.columns if n not in out]
    # a place asks for some hundred operations, by batches: as columns they make methods too long for the JVM to compile
    found = F.arrow_udf(_unprojected if wrapped else _unprojected_on, "struct<lon:double,lat:double>").asNondeterministic()
    rows = df.withColumn("_at", found(F.col(east).cast("double"), F.col(north).cast("double"), F.col(system)))
    return rows.select(*names, F.col("_at.lon").alias(out[0]), F.col("_at.lat").alias(out[1]))


def _system(system: pa.StructArray) -> dict[str, np.ndarray]:
    """The fields of rows' systems as arrays; series as rows of a matrix."""
    numbers = lambda v: v.to_numpy(zero_copy_only=False).astype(float)
    out = {}
    for f, v in zip(system.type, system.flatten(), strict=True):
        if pa.types.is_list(f.type):
            out[f.name] = np.full((len(v), 6), np.nan)
            good = v.is_valid().to_numpy(zero_copy_only=False)
            out[f.name][good] = numbers(v.filter(pa.array(good)).flatten()).reshape(-1, 6)
        elif f.name == "kind":
            out[f.name] = np.array(v.to_pylist(), object)
        else:
            out[f.name] = numbers(v)
    return out


def _series(xi: np.ndarray, eta: np.ndarray, c: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """_krueger over arrays."""
    for_xi, for_eta = xi, eta
    for j in range(6):
        k = 2.0 * (j + 1)
        for_xi = for_xi + sign * c[:, j] * np.sin(k * xi) * np.cosh(k * eta)
        for_eta = for_eta + sign * c[:, j] * np.cos(k * xi) * np.sinh(k * eta)
    return for_xi, for_eta


def _unprojected(east: pa.Array, north: pa.Array, system: pa.Array) -> pa.Array:
    return _places(east, north, system, True)


def _unprojected_on(east: pa.Array, north: pa.Array, system: pa.Array) -> pa.Array:
    return _places(east, north, system, False)


def _places(east: pa.Array, north: pa.Array, system: pa.Array, wrapped: bool) -> pa.Array:
    east, north = (v.to_numpy(zero_copy_only=False).astype(float) for v in (east, north))
    every, lon, lat = _system(system), np.full(len(east), np.nan), np.full(len(east), np.nan)
    with np.errstate(all="ignore"):
        for kind in KINDS:
            i = np.flatnonzero(every["kind"] == kind)
            s = {n: v[i] for n, v in every.items()}
            if kind == "GEOGRAPHIC":
                lon[i], lat[i] = east[i], north[i]
                continue
            x, y, down = (east[i] - s["east"]) * s["unit"], (north[i] - s["north"]) * s["unit"], None
            turn = np.where(s["south"] == 1, -1.0, 1.0) if kind == "POLAR" else 1.0
            if kind == "TM":
                xi, eta = _series(y / s["radius"] + s["xi0"], x / s["radius"], s["beta"], -1)
                c, l = np.sin(xi) / np.sqrt(np.sinh(eta) ** 2 + np.cos(xi) ** 2), np.arctan2(np.sinh(eta), np.cos(xi))
            elif kind == "POLAR":
                c, l = np.sinh(-np.log(np.sqrt(x * x + y * y) / s["rho"])), np.arctan2(x, -turn * y)
            elif kind == "LCC":
                sign, down = np.sign(s["cone"]), s["rho0"] - y
                c, l = np.sinh(-np.log(sign * np.sqrt(x * x + down * down) / s["big"]) / s["cone"]), np.arctan2(sign * x, sign * down) / s["cone"]
            else:
                c, l = np.sinh(y / s["axis"]), x / s["axis"]
            e = np.zeros(len(i)) if kind == "SPHERE" else s["e"]
            e2 = e * e
            t = c / (1 - e2)
            for _ in range(STEPS):
                h = np.sqrt(1 + t * t)
                g = np.sinh(e * np.arctanh(e * t / h))
                g = t * np.sqrt(1 + g * g) - g * h
                t = t + (c - g) / np.sqrt(1 + g * g) * (1 + (1 - e2) * t * t) / ((1 - e2) * h)
            at_pole = (kind == "POLAR") & (x == 0) & (y == 0)
            lat[i] = np.where(at_pole, 90.0, np.degrees(np.arctan(t))) * turn
            l = np.degrees(l + s["lon0"])
            lon[i] = l - 360 * np.floor((l + 180) / 360) if wrapped else l
    return pa.StructArray.from_arrays([pa.array(v, from_pandas=True) for v in (lon, lat)], ["lon", "lat"])
