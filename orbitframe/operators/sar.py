"""SAR contours on curved surfaces: constant heights, terrain, and the inverse projection."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.functions import geodesy as G
from orbitframe.functions import polynomials as P
from orbitframe.functions import sar_geometry as S
from orbitframe.functions.projective import homography, homography_inverse
from orbitframe.lineage import written

#: Fixed tolerances: height test and steps for a constant height; on-surface test of terrain; inverse projection.
HEIGHT_STEPS, HEIGHT_LIMIT = 3, 1.0
ON_SURFACE, CONTOUR_STEP = 0.001, 10.0
#: What contour_tracks adds that a point of the contour is made of.
TRACK = [*(f"_{n}_{a}" for n in ("ctr", "rx", "ry") for a in "xyz"), "_rad", "_cb", "_step", "_n"]
GROUND_LIMIT, GROUND_STEPS = 1e-2, 10
RANGE = 4096  # steps of a contour that are compared in one task


def _geodetic(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longitude, latitude and elevation of rows of ECEF places, as in functions.geodesy."""
    x, y, z = p.T
    r = np.hypot(x, y)
    beta = np.arctan2(G.A * z, G.B * r)
    for _ in range(3):
        s, c = np.sin(beta), np.cos(beta)
        lat = np.arctan2(z + G.EP2 * G.B * (s * s * s), r - G.E2 * G.A * (c * c * c))  # powers cost more than all the rest
        beta = np.arctan2((1 - G.FLATTENING) * np.sin(lat), np.cos(lat))
    n = G.A / np.sqrt(1 - G.E2 * np.sin(lat) ** 2)
    return np.arctan2(y, x), lat, r * np.cos(lat) + z * np.sin(lat) - G.A * G.A / n


def _ecef(lon: np.ndarray, lat: np.ndarray, elev: np.ndarray) -> np.ndarray:
    n = G.A / np.sqrt(1 - G.E2 * np.sin(lat) ** 2)
    return np.stack([(n + elev) * np.cos(lat) * np.cos(lon), (n + elev) * np.cos(lat) * np.sin(lon), (n * (1 - G.E2) + elev) * np.sin(lat)], 1)


def _up(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1)


def _on_plane(r: np.ndarray, rdot: np.ndarray, arp: np.ndarray, varp: np.ndarray, ref: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Where contours meet planes with unit normals z; not a number without a solution."""
    dots = lambda a, b: np.einsum("ij,ij->i", a, b)
    height = dots(arp - ref, z)
    ground = np.sqrt(r * r - height * height)
    v_z = dots(varp, z)
    v_x = np.sqrt(dots(varp, varp) - v_z * v_z)
    x = (varp - v_z[:, None] * z) / v_x[:, None]
    cos = (v_z * height / r - rdot) / (v_x * ground / r)
    sin = np.sign(dots(np.cross(arp - ref, varp), z)) * np.sqrt(1 - cos * cos)
    return arp - height[:, None] * z + (ground * cos)[:, None] * x + (ground * sin)[:, None] * np.cross(z, x)


def _height_points(r: pd.Series, rdot: pd.Series, ax: pd.Series, ay: pd.Series, az: pd.Series, vx: pd.Series, vy: pd.Series, vz: pd.Series, sx: pd.Series, sy: pd.Series, sz: pd.Series, look: pd.Series, hae: pd.Series) -> pd.DataFrame:
    stack = lambda *c: np.stack([x.to_numpy(float) for x in c], 1)
    arp, varp, scp = stack(ax, ay, az), stack(vx, vy, vz), stack(sx, sy, sz)
    r, rdot, hae, look = (x.to_numpy(float) for x in (r, rdot, hae, look))
    with np.errstate(all="ignore"):
        lon, lat, elev = _geodetic(scp)
        up = _up(lon, lat)
        ref, point, done = scp + (hae - elev)[:, None] * up, np.full(arp.shape, np.nan), np.zeros(len(r), bool)
        normal = up.copy()
        for _ in range(HEIGHT_STEPS):
            point = np.where(done[:, None], point, _on_plane(r, rdot, arp, varp, ref, normal))
            lon, lat, elev = _geodetic(point)
            up, high = _up(lon, lat), elev - hae
            done = ~(np.abs(high) > HEIGHT_LIMIT)
            ref, normal = point - high[:, None] * up, up
        slant = np.cross(look[:, None] * varp, point - arp)
        slant /= np.linalg.norm(slant, axis=1)[:, None]
        lon, lat, _ = _geodetic(point - (high / np.einsum("ij,ij->i", up, slant))[:, None] * slant)
        return pd.DataFrame(_ecef(lon, lat, hae), columns=["x", "y", "z"])


def on_height(df: DataFrame, r: str, rdot: str, arp: str, varp: str, scp: str, side: Column, hae: Column, out: str) -> DataFrame:
    """Column out: struct x, y, z where the contour meets a constant height above the ellipsoid, null if nowhere.

    arp, varp and scp name struct columns.  Each of at most three steps lays a plane that touches the surface under
    the last point; a row that is near enough keeps its point, whichever side of the surface it lies on.  The point
    is then moved along the slant plane's normal onto the surface.
    """
    parts = [c for n in (arp, varp, scp) for c in S.unpacked(F.col(n))]
    height_points = F.pandas_udf(_height_points, "struct<x:double,y:double,z:double>")
    point = height_points(F.col(r), F.col(rdot), *parts, F.when(side == "L", 1.0).otherwise(-1.0), hae)
    return df.withColumn(out, point).withColumn(out, F.when(~F.isnan(F.col(out)["x"]), F.col(out)))


def contour_points(df: DataFrame, r: str, rdot: str, arp: str, varp: str, low: str, high: str, side: Column, horizontal: float | None = None) -> DataFrame:
    """Points along each contour from the low surface point to past the high one: step, cos_angle and struct point.

    low and high name struct columns from on_height.  Points are evenly spaced in the cosine of the contour angle.
    """
    df = contour_tracks(df, r, rdot, arp, varp, low, high, horizontal)
    # a filter on the number of steps would be moved to the start of the plan, with all that it is made of
    df = df.withColumn("step", F.explode_outer(F.when(F.col("_n") >= 0, F.sequence(F.lit(0), F.col("_n"))))).where("step is not null")
    return _on_contour(df.withColumn("cos_angle", F.col("_cb") + F.col("step") * F.col("_step")), side)


def contour_tracks(df: DataFrame, r: str, rdot: str, arp: str, varp: str, low: str, high: str, horizontal: float | None = None) -> DataFrame:
    """Rows with the circle of each contour (TRACK): its centre, radius and axes, the cosine at the low point, the step and the number of steps."""
    rr, c = F.col(r), F.col
    df, at = S.spread(df, a=S.unpacked(c(arp)), v=S.unpacked(c(varp)), low=S.unpacked(c(low)), high=S.unpacked(c(high)))
    df = df.withColumn("_speed", S.norm(at["v"])).withColumn("_dca", -c(rdot) / c("_speed"))
    df, made = S.spread(df, uv=S.scale(at["v"], 1 / c("_speed")), ua=S.unit(at["a"]))
    df, more = S.spread(df.withColumn("_rad", rr * F.sqrt(1 - c("_dca") * c("_dca"))), ctr=S.add(at["a"], S.scale(made["uv"], rr * c("_dca"))), ry=S.unit(S.cross(made["ua"], made["uv"])))
    df, last = S.spread(df, rx=S.cross(more["ry"], made["uv"]))
    rad = c("_rad")
    angle = lambda n: S.dot(S.sub(at[n], more["ctr"]), last["rx"]) / rad
    df = df.withColumns({"_ca": angle("high"), "_cb": angle("low")})
    sin_b = F.sqrt(1 - c("_cb") * c("_cb"))
    step = F.lit(CONTOUR_STEP) * sin_b / rad
    if horizontal is not None:
        step = F.least(step, F.lit(horizontal) * sin_b / c("_cb") / rad)
    df = df.withColumn("_step", -step)
    return df.withColumn("_n", F.floor((c("_ca") - c("_cb")) / c("_step")).cast("int") + 1)


def _on_contour(df: DataFrame, side: Column) -> DataFrame:
    sin = F.when(side == "L", 1.0).otherwise(-1.0) * F.sqrt(1 - F.col("cos_angle") * F.col("cos_angle"))
    ctr, rx, ry = (tuple(F.col(f"_{n}_{a}") for a in "xyz") for n in ("ctr", "rx", "ry"))
    return df.withColumn("point", S.packed(S.add(ctr, S.scale(S.add(S.scale(rx, F.col("cos_angle")), S.scale(ry, sin)), F.col("_rad")))))


def crossings(points: DataFrame, key: str, delta: str, order: str = "step") -> DataFrame:
    """Where a contour's height above the terrain changes sign: step before, fraction to the next; touching points have fraction 0.

    A key's steps are compared in ranges of RANGE steps, each in a task of its own; the first step of the next range
    comes from an aggregate, so a key with very many steps is spread.
    """
    c = F.col
    sign = F.when(F.abs(c(delta)) < ON_SURFACE, 0).when(c(delta) > ON_SURFACE, 1).otherwise(-1)
    rows = points.withColumns({"_sign": sign, "_range": F.floor(c(order) / RANGE)}).withColumn("_at", F.struct(c(delta).alias("d"), c("_sign").alias("s")))
    heads = rows.groupBy(key, "_range").agg(F.min_by("_at", order).alias("_head"))
    heads = heads.select(c(key).alias("_key"), c("_range").alias("_of"), F.lead("_head").over(Window.partitionBy(key).orderBy("_range")).alias("_head"))
    inside = F.lead("_at").over(Window.partitionBy(key, "_range").orderBy(order))
    rows = rows.withColumn("_inside", inside).join(heads, c(key).eqNullSafe(c("_key")) & (c("_range") == c("_of"))).withColumn("_next", F.coalesce("_inside", "_head"))
    hit = (c("_sign") == 0) | (c("_sign") * c("_next.s") == -1)
    rows = rows.where(hit).withColumn("fraction", F.when(c("_sign") == 0, 0.0).otherwise(c(delta) / (c(delta) - c("_next.d"))))
    return rows.drop("_sign", "_range", "_at", "_inside", "_key", "_of", "_head", "_next")


def terrain_points(points: DataFrame, key: str, side: Column, delta: str = "delta") -> DataFrame:
    """Points where each contour meets the terrain, lowest first; points come from contour_points with their height above it."""
    hit = crossings(points, key, delta).withColumn("cos_angle", F.col("cos_angle") + F.col("fraction") * F.col("_step"))
    return _on_contour(hit, side)


def first_terrain_point(points: DataFrame, key: str, side: Column, delta: str = "delta") -> DataFrame:
    """The first meeting of each contour; contours that meet nothing are absent."""
    return terrain_points(points, key, side, delta).groupBy(key).agg(F.min_by("point", "step").alias("point"))


# From pixels to the ground and back, by models in rows.

#: What a model's row holds, as sources.products reads it.
SAR_MODEL = ["projection", "scp", "scp_row", "scp_col", "first_row", "first_col", "u_row", "u_col", "row_ss", "col_ss", "time_coa", "arp", "r_ca_scp", "time_ca", "rate", "polar", "factor", "az_factor", "scp_arp", "scp_varp", "side", "normal"]
KINDS = ["PFA", "RGAZCOMP", "INCA", "PLANE"]


def on_plane(df: DataFrame, r: str, rdot: str, arp: str, varp: str, ref: Column, normal: Column, out: str) -> DataFrame:
    """Column out: struct x, y, z where the contour meets a plane, as contour_on_plane, with each intermediate worked out once."""
    c, names = F.col, df.columns
    df, at = S.spread(df, a=S.unpacked(c(arp)), v=S.unpacked(c(varp)), f=S.unpacked(ref), n=S.unpacked(normal))
    df, made = S.spread(df, z=S.unit(at["n"]), d=S.sub(at["a"], at["f"]))
    a, v, z, d = at["a"], at["v"], made["z"], made["d"]
    df = df.withColumns({"_h": S.dot(d, z), "_vz": S.dot(v, z), "_look": F.signum(S.dot(S.cross(d, v), z))})
    df = df.withColumns({"_g": F.sqrt(F.greatest(c(r) * c(r) - c("_h") * c("_h"), F.lit(0.0))), "_vx": F.sqrt(S.dot(v, v) - c("_vz") * c("_vz"))})
    df = df.withColumn("_cos", F.try_divide(c("_vz") * c("_h") / c(r) - c(rdot), c("_vx") * c("_g") / c(r)))
    df = df.withColumn("_sin", c("_look") * F.sqrt(F.greatest(1 - c("_cos") * c("_cos"), F.lit(0.0))))
    df, x = S.spread(df, x=S.scale(S.sub(v, S.scale(z, c("_vz"))), 1 / c("_vx")))
    point = S.add(S.sub(a, S.scale(z, c("_h"))), S.add(S.scale(x["x"], c("_g") * c("_cos")), S.scale(S.cross(z, x["x"]), c("_g") * c("_sin"))))
    return df.withColumn("_point", F.when((c("_h") <= c(r)) & (F.abs(c("_cos")) <= 1), S.packed(point))).select(*(n for n in names if n != out), c("_point").alias(out))


def _models(params: DataFrame, key: str, *more: str) -> DataFrame:
    """key and the struct sar of each image's model, with the slopes of its polynomials, written once.

    Spark then knows how large they are.  By the guess for parsed documents it took the pixels for the smaller side of
    the join: it sent these to every task and left the work to as many tasks as there were pieces of documents.
    """
    track = F.struct(*(P.derivative(F.col("arp")[a]).alias(a) for a in "xyz")).alias("arp_rate")
    slopes = [track, *(P.derivative(F.col(n)).alias(f"{n}_rate") for n in ("polar", "factor"))]
    return written(params.select(key, F.struct(*SAR_MODEL, *(["chip_h"] if "chip_h" in params.columns else []), *more, *slopes).alias("sar")))


def contours(df: DataFrame, params: DataFrame, key: str = "image_id", x: str = "x", y: str = "y", offsets: bool = False) -> DataFrame:
    """Rows with r, rdot and the structs arp, varp and sar (the model) of their pixels.  Images without model are absent.

    Pixels of chips are those of the chip; chip_h of products.with_chips maps them to the full image.  With offsets,
    the parameters' columns range_bias, delta_arp and delta_varp (structs) adjust the result.
    """
    chip = "chip_h" in params.columns
    model = _models(params, key, *(["range_bias", "delta_arp", "delta_varp"] if offsets else []))
    kept = [n for n in df.columns if n not in ("sar", "r", "rdot", "arp", "varp")]
    m = F.col("sar").getField
    px, py = F.col(x), F.col(y)
    if chip:
        h = [m("chip_h")[i] for i in range(8)]
        full = homography_inverse(h, px, py)
        px, py = (F.when(m("chip_h").isNull(), v).otherwise(f) for v, f in ((px, full[0]), (py, full[1])))
    xr, yc = S.row_col_to_plane(py + m("first_row"), px + m("first_col"), m("scp_row"), m("scp_col"), m("row_ss"), m("col_ss"))
    rows = df.select(*kept).join(model, key).withColumns({"_xr": xr, "_yc": yc})
    rows = rows.withColumn("_t", P.surface(m("time_coa"), F.col("_xr"), F.col("_yc")))
    # what is asked for more than once is a column, and only rows of its kind work it out; slopes of polynomials come with the model
    of = lambda k, v: F.when(m("projection") == k, v)
    rg, az, t = F.col("_xr"), F.col("_yc"), F.col("_t")
    track, slopes = S.unpacked(m("arp")), S.unpacked(m("arp_rate"))
    rows, at = S.spread(rows, arp=P.vector(*track, t), varp=P.vector(*slopes, t), scp=S.unpacked(m("scp")))
    arp, varp, scp = at["arp"], at["varp"], at["scp"]
    rows = rows.withColumns({"_theta": of("PFA", P.horner(m("polar"), t)), "_turn": of("PFA", P.horner(m("polar_rate"), t)), "_tca": of("INCA", P.horner(m("time_ca"), az)), "_f": of("INCA", P.surface(m("rate"), rg, az))})
    theta, f, dt = F.col("_theta"), F.col("_f"), t - F.col("_tca")
    rows, ca = S.spread(rows.withColumns({"_k": of("PFA", P.horner(m("factor"), theta)), "_k1": of("PFA", P.horner(m("factor_rate"), theta))}), vca=tuple(of("INCA", P.horner(c, F.col("_tca"))) for c in slopes))
    rows, sight = S.spread(rows, los=tuple(of("PLANE", v) for v in S.sub(arp, S.plane_point(rg, az, scp, S.unpacked(m("u_row")), S.unpacked(m("u_col"))))))
    v2, r0 = S.dot(ca["vca"], ca["vca"]), S.sub(arp, scp)
    rows = rows.withColumns({"_rlos": S.norm(sight["los"]), "_v2": v2, "_r0": S.norm(r0), "_along": rg * F.cos(theta) + az * F.sin(theta), "_across": az * F.cos(theta) - rg * F.sin(theta)})
    rows = rows.withColumns({"_d0": S.dot(varp, r0) / F.col("_r0"), "_rca": F.sqrt((m("r_ca_scp") + rg) * (m("r_ca_scp") + rg) + f * F.col("_v2") * dt * dt)})
    made = {
        "PFA": (F.col("_r0") + F.col("_k") * F.col("_along"), F.col("_d0") + (F.col("_k1") * F.col("_along") + F.col("_k") * F.col("_across")) * F.col("_turn")),
        "RGAZCOMP": S.range_azimuth_compressed(rg, az, arp, varp, scp, m("az_factor")),
        "INCA": (F.col("_rca"), f / F.col("_rca") * F.col("_v2") * dt), "PLANE": (F.col("_rlos"), S.dot(varp, sight["los"]) / F.col("_rlos")),
    }
    pair = F.coalesce(*(of(k, F.struct(v[0].alias("r"), v[1].alias("rdot"))) for k, v in made.items()))
    rows = rows.withColumn("_pair", pair).withColumns({"r": F.col("_pair.r"), "rdot": F.col("_pair.rdot"), "arp": S.packed(arp), "varp": S.packed(varp)})
    if offsets:
        r, a, v = S.adjusted(F.col("r"), arp, varp, m("range_bias"), S.unpacked(m("delta_arp")), S.unpacked(m("delta_varp")))
        rows = rows.withColumns({"r": r, "arp": S.packed(a), "varp": S.packed(v)})
    return rows.select(*kept, "r", "rdot", "arp", "varp", "sar")


def with_geodetic(df: DataFrame, point: Column, names: tuple[str, str, str] = ("lon_deg", "lat_deg", "height")) -> DataFrame:
    """Columns of longitude and latitude in degrees and height of an ECEF struct, as G.ecef_to_geodetic with each step worked out once."""
    c = F.col
    kept = [n for n in df.columns if n not in names]
    df, at = S.spread(df, g=S.unpacked(point))
    x, y, z = at["g"]
    df = df.withColumn("_p", F.sqrt(x * x + y * y))
    df = df.withColumn("_beta", F.atan2(F.lit(G.A) * z, F.lit(G.B) * c("_p")))
    for last in (False, False, True):
        df = df.withColumns({"_s": F.sin("_beta"), "_c": F.cos("_beta")})
        df = df.withColumn("_lat", F.atan2(z + F.lit(G.EP2 * G.B) * c("_s") * c("_s") * c("_s"), c("_p") - F.lit(G.E2 * G.A) * c("_c") * c("_c") * c("_c")))
        df = df.withColumns({"_s": F.sin("_lat"), "_c": F.cos("_lat")})
        if not last:
            df = df.withColumn("_beta", F.atan2(F.lit(1 - G.FLATTENING) * c("_s"), c("_c")))
    height = c("_p") * c("_c") + z * c("_s") - F.lit(G.A) * F.sqrt(1 - F.lit(G.E2) * c("_s") * c("_s"))
    lon, lat, elev = names
    return df.select(*kept, F.degrees(F.atan2(y, x)).alias(lon), F.degrees("_lat").alias(lat), height.alias(elev))


def _located(rows: DataFrame, kept: list[str], point: str) -> DataFrame:
    return with_geodetic(rows, F.col(point)).select(*kept, F.col(point).alias("place"), "lon_deg", "lat_deg", "height")


def image_to_world(df: DataFrame, params: DataFrame, key: str = "image_id", x: str = "x", y: str = "y", offsets: bool = False) -> DataFrame:
    """Rows with place (ECEF), lon_deg, lat_deg and height of their pixels on the ground plane through the centre point.

    The plane has the model's normal, or else that of constant height; pixels whose contour misses it have nulls.
    """
    rows = contours(df, params, key, x, y, offsets)
    m = F.col("sar").getField
    kept = [n for n in df.columns if n not in ("sar", "r", "rdot", "arp", "varp", "place", "lon_deg", "lat_deg", "height")]
    rows = with_geodetic(rows, m("scp"), ("_lon", "_lat_deg", "_elev"))
    rows = rows.withColumn("_up", F.coalesce(m("normal"), S.packed(G.up_vector(F.radians("_lon"), F.radians("_lat_deg")))))
    return _located(on_plane(rows, "r", "rdot", "arp", "varp", m("scp"), F.col("_up"), "_place"), kept, "_place")


class _Models(NamedTuple):
    """Models of the rows of a batch as arrays of one row each."""

    kind: np.ndarray
    scp: np.ndarray
    u_row: np.ndarray
    u_col: np.ndarray
    time: np.ndarray
    arp: np.ndarray
    r_ca: np.ndarray
    time_ca: np.ndarray
    rate: np.ndarray
    polar: np.ndarray
    factor: np.ndarray
    az: np.ndarray


def _filled(values: pd.Series) -> np.ndarray:
    """Arrays of any lengths, or null, as rows of one matrix filled with zeros."""
    arrays = [np.zeros(0) if v is None else np.asarray(v, float) for v in values]
    out = np.zeros((len(arrays), max(1, max(map(len, arrays), default=1))))
    for i, a in enumerate(arrays):
        out[i, : len(a)] = a
    return out


def _surfaces(values: pd.Series) -> np.ndarray:
    """Arrays of arrays as n x rows x columns."""
    rows = [[np.zeros(1)] if v is None else list(v) for v in values]
    out = np.zeros((len(rows), max(len(v) for v in rows), max(len(r) for v in rows for r in v)))
    for i, v in enumerate(rows):
        for j, r in enumerate(v):
            out[i, j, : len(r)] = r
    return out


def _horner(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Polynomials c[row, power] at t[row]; further axes of c are kept."""
    total = np.zeros(c[:, 0].shape)
    at = t.reshape(t.shape + (1,) * (total.ndim - 1))
    for k in range(c.shape[1] - 1, -1, -1):
        total = total * at + c[:, k]
    return total


def _surface(c: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _horner(_horner(np.moveaxis(c, 2, 1), y), x)


def _slope(c: np.ndarray) -> np.ndarray:
    """Derivative of polynomials c[row, power]."""
    if c.shape[1] == 1:
        return np.zeros_like(c)
    return c[:, 1:] * np.arange(1, c.shape[1]).reshape((1, -1) + (1,) * (c.ndim - 2))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def _contour(m: _Models, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Range, range rate, position and velocity of places of the image plane; the formulas are those of functions.sar_geometry."""
    t = _surface(m.time, x, y)
    p, v = _horner(m.arp, t), _horner(_slope(m.arp), t)
    to_scp = p - m.scp
    r0 = np.linalg.norm(to_scp, axis=1)
    d0 = _dot(v, to_scp) / r0
    los = p - (m.scp + x[:, None] * m.u_row + y[:, None] * m.u_col)
    r = np.linalg.norm(los, axis=1)
    rdot = _dot(v, los) / r
    for k in set(KINDS[:3]) & set(m.kind):
        i = m.kind == k
        if k == "PFA":
            theta, turn = _horner(m.polar[i], t[i]), _horner(_slope(m.polar[i]), t[i])
            f, f1 = _horner(m.factor[i], theta), _horner(_slope(m.factor[i]), theta)
            along, across = x[i] * np.cos(theta) + y[i] * np.sin(theta), y[i] * np.cos(theta) - x[i] * np.sin(theta)
            r[i], rdot[i] = r0[i] + f * along, d0[i] + (f1 * along + f * across) * turn
        elif k == "RGAZCOMP":
            r[i], rdot[i] = r0[i] + x[i], d0[i] - np.linalg.norm(v[i], axis=1) * m.az[i] * y[i]
        else:
            t_ca = _horner(m.time_ca[i], y[i])
            speed = _horner(_slope(m.arp[i]), t_ca)
            v2, dt, f = _dot(speed, speed), t[i] - t_ca, _surface(m.rate[i], x[i], y[i])
            r[i] = np.sqrt((m.r_ca[i] + x[i]) ** 2 + f * v2 * dt * dt)
            rdot[i] = f / r[i] * v2 * dt
    return r, rdot, p, v


def _to_image(keys: pa.Array, models: pa.Array, place: pa.Array) -> pa.Array:
    """Pixels of places; the models of a batch, told apart by their keys, are unpacked once each and not once a row."""
    named = lambda s: dict(zip([f.name for f in s.type], s.flatten(), strict=True))
    _, first, of = np.unique(keys.to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
    m = pd.DataFrame({n: v.to_pandas() for n, v in named(models.take(pa.array(first))).items()})
    vector = lambda n: np.stack([[q["x"], q["y"], q["z"]] for q in m[n]]).astype(float)[of]
    number = lambda n: m[n].to_numpy(float)[of]
    each = lambda n: np.stack([[q["x"], q["y"], q["z"]] for q in m[n]]).astype(float)
    plain = lambda n: m[n].to_numpy(float)
    model = _Models(
        m["projection"].to_numpy(), each("scp"), each("u_row"), each("u_col"), _surfaces(m["time_coa"]), np.moveaxis(_aligned([_filled(pd.Series([q[a] for q in m["arp"]])) for a in "xyz"]), 0, 2),
        plain("r_ca_scp"), _filled(m["time_ca"]), _surfaces(m["rate"]), _filled(m["polar"]), _filled(m["factor"]), plain("az_factor"),
    )
    model = _Models(*(v[of] for v in model))
    s = np.stack([named(place)[a].to_numpy(zero_copy_only=False).astype(float) for a in "xyz"], 1)
    with np.errstate(all="ignore"):
        plane = np.cross(model.u_row, model.u_col)
        plane /= np.linalg.norm(plane, axis=1)[:, None]
        slant = np.cross(vector("scp_varp"), model.scp - vector("scp_arp"))
        slant *= np.where(m["side"].to_numpy() == "R", -1, 1)[of][:, None] / np.linalg.norm(slant, axis=1)[:, None]
        lon, lat, _ = _geodetic(s)
        own = np.stack([np.full(3, np.nan) if n is None else [n["x"], n["y"], n["z"]] for n in m["normal"]]).astype(float)
        given = np.array([n is not None for n in m["normal"]])
        up = np.where(given[of][:, None], own[of], _up(lon, lat))
        up /= np.linalg.norm(up, axis=1)[:, None]
        g, x, y, miss = s.copy(), np.full(len(s), np.nan), np.full(len(s), np.nan), np.full(len(s), np.inf)
        cos = _dot(model.u_row, model.u_col)
        for _ in range(GROUND_STEPS):
            go = np.flatnonzero(miss > GROUND_LIMIT)
            if not len(go):
                break
            part = _Models(*(v[go] for v in model))
            i = g[go] + (_dot(part.scp - g[go], plane[go]) / _dot(slant[go], plane[go]))[:, None] * slant[go]
            a, e, c = _dot(i - part.scp, part.u_row), _dot(i - part.scp, part.u_col), cos[go]
            x[go], y[go] = (a - c * e) / (1 - c * c), (e - c * a) / (1 - c * c)
            r, rdot, p, v = _contour(part, x[go], y[go])
            diff = s[go] - _on_plane(r, rdot, p, v, s[go], up[go])
            g[go] += diff
            miss[go] = np.linalg.norm(diff, axis=1)
        row, col = x / number("row_ss") + number("scp_row") - number("first_row"), y / number("col_ss") + number("scp_col") - number("first_col")
    good = np.isfinite(miss)
    return pa.StructArray.from_arrays([pa.array(v) for v in (np.where(good, col, np.nan), np.where(good, row, np.nan), miss)], ["x", "y", "miss"])


def _aligned(parts: list[np.ndarray]) -> np.ndarray:
    """Matrices of the same rows filled to the same width, stacked."""
    width = max(p.shape[1] for p in parts)
    return np.stack([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


def world_to_image(df: DataFrame, params: DataFrame, key: str = "image_id", lon_deg: str = "lon_deg", lat_deg: str = "lat_deg", height: str = "height") -> DataFrame:
    """Rows with x and y of their places' pixels, and miss, how far in metres the pixel's contour passes the place.

    Every step projects along the slant plane's normal to the image plane and back to the plane through the place;
    ten at most are taken, until it is within a centimetre.  The rows of a batch step together, whatever their
    models, which come in rows.  Places without solution have nulls.
    """
    chip = "chip_h" in params.columns
    model = _models(params, key).select(key, F.struct(*(F.col("sar")[n].alias(n) for n in SAR_MODEL)).alias("_m"), *([F.col("sar.chip_h").alias("_chip")] if chip else []))
    kept = [n for n in df.columns if n not in ("x", "y", "miss")]
    place = S.packed(G.geodetic_to_ecef(F.radians(lon_deg), F.radians(lat_deg), F.col(height)))
    found = F.arrow_udf(_to_image, "struct<x:double,y:double,miss:double>")
    rows = df.join(model, key).withColumn("_at", place).withColumn("_found", found(F.col(key).cast("string"), "_m", "_at"))
    rows = rows.withColumns({n: F.when(~F.isnan(F.col("_found")[n]), F.col("_found")[n]) for n in "xy"} | {"miss": F.col("_found")["miss"]})
    if chip:
        h = [F.col("_chip")[i] for i in range(8)]
        x, y = homography(h, F.col("x"), F.col("y"))
        rows = rows.withColumns({"x": F.when(F.col("_chip").isNull(), F.col("x")).otherwise(x), "y": F.when(F.col("_chip").isNull(), F.col("y")).otherwise(y)})
    return rows.select(*kept, "x", "y", "miss")
