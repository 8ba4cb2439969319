"""Sensor models: parameters are rows joined on image_id, never captured in closures.

Forward and closed-form inverse maps are columns; solvers that need a varying number of steps are Arrow-batched
and vectorised over the rows of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.functions import geodesy as G
from orbitframe.functions import polynomials as P
from orbitframe.functions import projective as M

#: Names of the rational model's offsets and scales.
RPC_NORMS = ["line_off", "samp_off", "lat_off", "long_off", "height_off", "line_scale", "samp_scale", "lat_scale", "long_scale", "height_scale"]
RPC_POLYS = ["line_num", "line_den", "samp_num", "samp_den"]


def with_parameters(df: DataFrame, parameters: DataFrame, key: str = "image_id") -> DataFrame:
    """Rows with their image's parameters; Spark broadcasts the table while its size is under the session's limit."""
    return df.join(parameters, key)


def rpc_forward(lon_deg: Column, lat_deg: Column, height: Column, p=F.col) -> tuple[Column, Column]:
    """(sample, line) of a place by the rational polynomial in the row."""
    lon, lat, h = P.normalize(lon_deg, p("long_off"), p("long_scale")), P.normalize(lat_deg, p("lat_off"), p("lat_scale")), P.normalize(height, p("height_off"), p("height_scale"))
    ratio = lambda n: P.rpc(p(f"{n}_num"), lon, lat, h) / P.rpc(p(f"{n}_den"), lon, lat, h)
    return P.denormalize(ratio("samp"), p("samp_off"), p("samp_scale")), P.denormalize(ratio("line"), p("line_off"), p("line_scale"))


RPC_STEPS = 6


def _rpc_terms(l: np.ndarray, p: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The twenty terms, a row each, and their derivatives by the first two variables."""
    power = lambda v: [np.ones_like(v), v, v * v, v * v * v]
    lp, pp, hp = power(l), power(p), power(h)
    value, by_l, by_p = np.empty((3, len(P.RPC_TERMS), len(l)))
    for k, (a, b, c) in enumerate(P.RPC_TERMS):
        value[k] = lp[a] * pp[b] * hp[c]
        by_l[k] = a * lp[a - 1] * pp[b] * hp[c] if a else 0
        by_p[k] = b * lp[a] * pp[b - 1] * hp[c] if b else 0
    return value, by_l, by_p


def _numbers(column: pa.Array) -> np.ndarray:
    """A column's numbers; null is not a number."""
    return column.to_numpy(zero_copy_only=False).astype(float)


def _rows_of(lists: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of one matrix; null and lists of another length are rows that are no numbers."""
    out = np.full((len(lists), width), np.nan)
    good = np.nan_to_num(_numbers(pc.list_value_length(lists)), nan=-1) == width
    out[good] = _numbers(lists.filter(pa.array(good)).flatten()).reshape(-1, width)
    return out


def _rpc_solved(x: pa.Array, y: pa.Array, height: pa.Array, model: pa.Array, lon0: pa.Array, lat0: pa.Array) -> pa.Array:
    m = np.ascontiguousarray(_rows_of(model, len(RPC_NORMS) + 80).T)
    v = dict(zip(RPC_NORMS, m, strict=False))
    c = {name: m[10 + 20 * k : 30 + 20 * k] for k, name in enumerate(RPC_POLYS)}
    number = _numbers
    with np.errstate(all="ignore"):
        want = (number(x) - v["samp_off"]) / v["samp_scale"], (number(y) - v["line_off"]) / v["line_scale"]
        h = (number(height) - v["height_off"]) / v["height_scale"]
        l, p = (np.nan_to_num((number(s) - v[f"{k}_off"]) / v[f"{k}_scale"], nan=0.0) for s, k in ((lon0, "long"), (lat0, "lat")))
        dot = lambda name, t: np.einsum("ij,ij->j", c[name], t)
        for step in range(RPC_STEPS + 1):
            t, tl, tp = _rpc_terms(l, p, h)
            at = []
            for k in ("samp", "line"):
                num, den = dot(f"{k}_num", t), dot(f"{k}_den", t)
                slope = lambda d: (dot(f"{k}_num", d) * den - num * dot(f"{k}_den", d)) / (den * den)  # noqa: B023, E731
                at.append((num / den, slope(tl), slope(tp)))
            (s, sl, sp), (r, rl, rp) = at
            ds, dr = s - want[0], r - want[1]
            if step == RPC_STEPS or not (np.hypot(ds, dr) > 1e-14).any():
                break
            det = sl * rp - sp * rl
            l, p = l - (ds * rp - dr * sp) / det, p - (dr * sl - ds * rl) / det
        residual = np.hypot(ds * v["samp_scale"], dr * v["line_scale"])
        return pa.StructArray.from_arrays([pa.array(a) for a in (l * v["long_scale"] + v["long_off"], p * v["lat_scale"] + v["lat_off"], residual)], ["lon_deg", "lat_deg", "residual"])


#: A column that rpc_inverse takes for the model where rows have it: the offsets, scales and coefficients in one array.
RPC_MODEL = "_rpc_model"


def _rpc_model() -> Column:
    return F.concat(F.array(*(F.col(n).cast("double") for n in RPC_NORMS)), *RPC_POLYS)


def rpc_inverse(df: DataFrame, samp: str = "x", line: str = "y", height: str = "height", seed: tuple[str, str] | None = None) -> DataFrame:
    """Rows, which carry their model's parameters, with lon_deg and lat_deg at a known height, and the residual in pixels.

    Newton steps from the model's centre, or from the places (longitude and latitude in degrees) that the seed names;
    only pixel, height, seed and parameters cross to Python.  Rows without a model or a solution get nulls.
    """
    names = ["lon_deg", "lat_deg", "residual"]
    kept = [n for n in df.columns if n not in names]
    model = F.col(RPC_MODEL) if RPC_MODEL in df.columns else _rpc_model()
    start = [F.col(n).cast("double") for n in seed] if seed else [F.lit(None).cast("double")] * 2
    # said to differ from call to call, so that what is asked of its result doesn't run it again
    solved = F.arrow_udf(_rpc_solved, "struct<lon_deg:double,lat_deg:double,residual:double>").asNondeterministic()
    rows = df.withColumn("_found", solved(*(F.col(n).cast("double") for n in (samp, line, height)), model, *start))
    found = F.col("_found")
    return rows.select(*kept, *(F.when(~F.isnan(found["residual"]), found[n]).alias(n) for n in names))


def rpc_composite(df: DataFrame, approximate: tuple[Column, Column], samp: str = "x", line: str = "y", height: str = "height") -> DataFrame:
    """Places by the rational model, whose search starts at the approximate model's place (in degrees); that place where the rational model has none."""
    lon, lat = approximate
    rows = rpc_inverse(df.withColumns({"_lon": lon, "_lat": lat}), samp, line, height, ("_lon", "_lat"))
    return rows.withColumns({"lon_deg": F.coalesce("lon_deg", "_lon"), "lat_deg": F.coalesce("lat_deg", "_lat")}).drop("_lon", "_lat")


def rpc_inverse_on_terrain(df: DataFrame, sample, rounds: int = 3, samp: str = "x", line: str = "y") -> DataFrame:
    """Places on the terrain: project at a height, sample the elevation there, and repeat.

    sample(df) adds the column terrain; where it is null the last height stays.
    """
    names = df.columns
    out = df.withColumns({"height": F.col("height_off"), RPC_MODEL: _rpc_model()})
    for _ in range(rounds):
        found = sample(rpc_inverse(out, samp, line).drop("residual"))
        out = found.withColumn("height", F.coalesce("terrain", "height")).select(*names, "height", RPC_MODEL)
    return rpc_inverse(out, samp, line).drop(RPC_MODEL)


# Replacement models.


def ground_domain(form: Column, lon: Column, lat: Column, elev: Column, origin: Column, axes: Column) -> tuple[Column, Column, Column]:
    """Coordinates of a place in the form's system: G geodetic, H longitude in [0, 2 pi), R rectangular."""
    x, y, z = G.geodetic_to_ecef(lon, lat, elev)
    d = (x - origin["x"], y - origin["y"], z - origin["z"])
    turn = lambda i: axes[i][0] * d[0] + axes[i][1] * d[1] + axes[i][2] * d[2]
    pick = lambda r, h, g: F.when(form == "R", r).when(form == "H", h).otherwise(g)
    return pick(turn(0), G.floor_mod(lon, 2 * G.PI), lon), pick(turn(1), lat, lat), pick(turn(2), elev, elev)


def ground_domain_inverse(form: Column, x: Column, y: Column, z: Column, origin: Column, axes: Column) -> tuple[Column, Column, Column]:
    """Longitude, latitude and elevation; in form H the longitude stays as it is."""
    back = lambda i, o: axes[0][i] * x + axes[1][i] * y + axes[2][i] * z + o
    lon, lat, elev = G.ecef_to_geodetic(back(0, origin["x"]), back(1, origin["y"]), back(2, origin["z"]))
    pick = lambda r, v: F.when(form == "R", r).otherwise(v)
    return pick(lon, x), pick(lat, y), pick(elev, z)


def rsm_forward(x: Column, y: Column, z: Column, powers: dict[str, tuple[int, int, int]] | None = None, p=F.col) -> tuple[Column, Column]:
    """(column, row) of a ground-domain place; rn, rd, cn and cd are the row's coefficient arrays, whose powers are given or the row's rn_powers and so on."""
    n = [P.normalize(v, p(f"{a}_off"), p(f"{a}_scale")) for v, a in ((x, "x"), (y, "y"), (z, "z"))]
    value = lambda k: P.rsm(p(k), *powers[k], *n) if powers else P.rsm_of_powers(p(k), p(f"{k}_powers"), *n)
    return P.denormalize(value("cn") / value("cd"), p("col_off"), p("col_scale")), P.denormalize(value("rn") / value("rd"), p("row_off"), p("row_scale"))


def section_index(row: Column, col: Column, p=F.col) -> tuple[Column, Column]:
    """(section row, section column) from 0, kept within the image's sections."""
    at = lambda v, least, size, n: F.greatest(F.lit(0), F.least(F.floor((v - least) / size), n - 1)).cast("int")
    return at(row, p("min_row"), p("row_size"), p("n_rows")), at(col, p("min_col"), p("col_size"), p("n_cols"))


def section_of_place(x: Column, y: Column, z: Column, p=F.col) -> tuple[Column, Column]:
    """Section by the low-order polynomials of a place."""
    return section_index(P.low_order(p("row_poly"), x, y, z), P.low_order(p("col_poly"), x, y, z), p)


#: Of the parameters, those of the whole image and those of a section.
RSM_POLYS = ["rn", "rd", "cn", "cd"]
RSM_NORMS = [f"{n}_{w}" for n in ("row", "col", "x", "y", "z") for w in ("off", "scale")]
RSM_IMAGE = ["form", "origin", "axes", "n_rows", "n_cols", "row_size", "col_size", "min_row", "min_col", "row_poly", "col_poly"]
RSM_SECTION = [*RSM_NORMS, *RSM_POLYS, *(f"{k}_powers" for k in RSM_POLYS)]
RSM_STEPS, RSM_LIMIT = 25, 1e-9  # of the inverse: rounds, and pixels from which a row is done


def rsm_models(parameters: DataFrame, sections: DataFrame, key: str = "image_id") -> DataFrame:
    """One row per section, counted from 0, of the images with a whole replacement model, from their polynomial and section records.

    A single polynomial record holds for its whole image.  Of several records of a section the last counts, and
    records outside the announced sections don't.  Images with several records but no section record, with a
    section without record, or with a record that doesn't parse have no model.  Box and height are geodetic: the
    bounds of the vertices, and the height of the reference point, or else the vertices' mean.
    """
    c = F.col
    fits = lambda k: F.size(k) == (c(f"{k}_powers")[0] + 1) * (c(f"{k}_powers")[1] + 1) * (c(f"{k}_powers")[2] + 1)
    good = ~F.exists(F.array(*RSM_NORMS), lambda v: v.isNull()) & ~F.exists("vertices", lambda v: v["x"].isNull() | v["y"].isNull() | v["z"].isNull()) & c("form").isin("G", "H", "R")
    good &= c("section_row").isNotNull() & c("section_col").isNotNull()
    good &= (c("form") != "R") | (c("origin.x").isNotNull() & c("origin.y").isNotNull() & c("origin.z").isNotNull() & ~F.exists(F.flatten("axes"), lambda v: v.isNull()))
    for k in RSM_POLYS:
        good &= F.coalesce(fits(k), F.lit(False)) & ~F.exists(k, lambda v: v.isNull())
    several = c("n_records") > 1
    whole = {"n_rows": F.lit(1), "n_cols": F.lit(1), "row_size": F.lit(1.0), "col_size": F.lit(1.0), "min_row": F.lit(0.0), "min_col": F.lit(0.0), **{n: F.array_repeat(F.lit(0.0), 10) for n in ("row_poly", "col_poly")}}
    rows = parameters.withColumn("good", F.coalesce(good, F.lit(False))).join(sections, key, "left")
    rows = rows.withColumns({n: F.when(several, c(n)).otherwise(v) for n, v in whole.items()})
    rows = rows.withColumns({n: F.when(several, c(n) - 1).otherwise(0) for n in ("section_row", "section_col")})
    usable = rows.groupBy(key).agg(F.bool_and("good").alias("usable")).where("usable").select(key)
    rows = rows.where(c("section_row").between(0, c("n_rows") - 1) & c("section_col").between(0, c("n_cols") - 1) & (c("row_size") > 0) & (c("col_size") > 0) & ~F.exists(F.concat("row_poly", "col_poly"), lambda v: v.isNull()) & c("min_row").isNotNull() & c("min_col").isNotNull())
    last = rows.groupBy(key, "section_row", "section_col").agg(F.max_by(F.struct(*(n for n in rows.columns if n not in (key, "section_row", "section_col"))), "record").alias("m")).select(key, "section_row", "section_col", "m.*")
    counted = last.groupBy(key).agg(F.count("*").alias("n"), (F.max("n_rows") * F.max("n_cols")).alias("announced")).where("n = announced").select(key)
    found = last.join(usable, key).join(counted, key)
    return found.join(_geodetic_domains(found.where("section_row = 0 and section_col = 0"), key), key).select(key, "section_row", "section_col", *RSM_IMAGE, *RSM_SECTION, "box", "start", "height")


def _geodetic_domains(images: DataFrame, key: str) -> DataFrame:
    """Per image, box (least and largest longitude and latitude) and start of the search in radians, and the model's own height."""
    flat = lambda v: F.array(*(F.col(v)[n] for n in "xyz"))
    rows = images.select(key, "form", flat("origin").alias("origin"), F.flatten("axes").alias("axes"), F.flatten(F.transform("vertices", lambda v: F.array(v["x"], v["y"], v["z"]))).alias("vertices"), flat("reference_point").alias("reference"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for form, origin, axes, vertices, reference in zip(*(b[n] for n in ("form", "origin", "axes", "vertices", "reference")), strict=True):
                points = np.append(vertices, reference).astype(float).reshape(9, 3)
                if form == "R":
                    points = _geodetic(np.linalg.solve(np.array(axes, float).reshape(3, 3), points.T).T + np.array(origin, float))
                corners, own = points[:8], points[8, 2]
                out.append(([*corners[:, :2].min(0), *corners[:, :2].max(0)], list((corners[0, :2] + corners[3, :2]) / 2), own if np.isfinite(own) else corners[:, 2].mean()))
            yield pd.DataFrame({key: b[key], **{n: pd.Series([o[i] for o in out], index=b.index, dtype=object if i < 2 else float) for i, n in enumerate(("box", "start", "height"))}})

    return rows.mapInPandas(run, f"`{key}` {images.schema[key].dataType.simpleString()}, box array<double>, start array<double>, height double")


def rsm_world_to_image(df: DataFrame, models: DataFrame, key: str = "image_id", lon_deg: str = "lon_deg", lat_deg: str = "lat_deg", height: str = "height") -> DataFrame:
    """Rows with x and y of their places by the model of the section that the low-order polynomials find; rows of images without model are absent.

    A pixel is null where a denominator is zero.
    """
    kept = [n for n in df.columns if n not in ("x", "y")]
    images = models.where("section_row = 0 and section_col = 0").select(key, F.struct(*RSM_IMAGE).alias("_image"))
    image = F.col("_image").getField
    domain = ground_domain(image("form"), F.radians(lon_deg), F.radians(lat_deg), F.col(height), image("origin"), image("axes"))
    rows = df.join(images, key).withColumns({f"_{n}": v for n, v in zip("xyz", domain, strict=True)})
    place = F.col("_x"), F.col("_y"), F.col("_z")
    row, col = section_of_place(*place, image)
    rows = rows.withColumns({"_row": row, "_col": col})
    rows = rows.join(models.select(key, F.col("section_row").alias("_row"), F.col("section_col").alias("_col"), F.struct(*RSM_SECTION).alias("_section")), [key, "_row", "_col"])
    found = F.arrow_udf(_rsm_pixels, "struct<x:double,y:double>")
    at = rows.withColumn("_at", found(_section_name(key), "_section", *place))
    return at.select(*kept, F.col("_at.x").alias("x"), F.col("_at.y").alias("y"))


def _rsm_rows(arrays: pd.Series) -> np.ndarray:
    """Arrays of several lengths as rows of one matrix, filled with zeros."""
    out = np.zeros((len(arrays), max(len(a) for a in arrays)))
    for i, a in enumerate(arrays):
        out[i, : len(a)] = a
    return out


def _rsm_value(c: np.ndarray, powers: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Polynomials c[row] with powers[row] at q[row]; rows of the same powers go together, their powers of q by products."""
    if (powers == powers[0]).all():
        return _rsm_sum(c, powers[0], q)
    out = np.empty(len(q))
    kinds, of = np.unique(powers, axis=0, return_inverse=True)
    for k, kind in enumerate(kinds):
        i = np.flatnonzero(of.ravel() == k)
        out[i] = _rsm_sum(c[i], kind, q[i])
    return out


def _rsm_sum(c: np.ndarray, powers: np.ndarray, q: np.ndarray) -> np.ndarray:
    total, n = np.zeros(len(q)), 0
    up = [[None] for _ in range(3)]
    for a in range(3):
        for k in range(1, powers[a] + 1):
            up[a].append(q[:, a] if k == 1 else up[a][-1] * q[:, a])
    for z in up[2]:
        for y in up[1]:
            for x in up[0]:
                term = c[:, n]
                for factor in (x, y, z):
                    term = term if factor is None else term * factor
                total, n = total + term, n + 1
    return total


def _section_name(key: str) -> Column:
    """A section's name among those of all images."""
    return F.concat_ws("/", F.col(key).cast("string"), F.col("_row").cast("string"), F.col("_col").cast("string"))


def _sections(names: pa.Array, models: pa.StructArray) -> tuple[dict[str, pd.Series], np.ndarray]:
    """The fields of a batch's sections, which are unpacked once each and not once a row, and the section of each row."""
    coded = names.dictionary_encode()
    of = coded.indices.to_numpy()
    _, first = np.unique(of, return_index=True)
    taken = models.take(pa.array(first))
    return {f.name: v.to_pandas() for f, v in zip(taken.type, taken.flatten(), strict=True)}, of


def _rsm_pixels(names: pa.Array, models: pa.Array, x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
    if not len(names):
        return pa.StructArray.from_arrays([pa.array([], pa.float64())] * 2, ["x", "y"])
    m, of = _sections(names, models)
    v = {n: m[n].to_numpy(float)[of] for n in RSM_NORMS}
    with np.errstate(all="ignore"):
        q = np.stack([(a.to_numpy(zero_copy_only=False).astype(float) - v[f"{n}_off"]) / v[f"{n}_scale"] for a, n in ((x, "x"), (y, "y"), (z, "z"))], 1)
        powers = {n: np.stack(m[f"{n}_powers"].to_numpy()).astype(int) for n in RSM_POLYS}
        if any(len(c) != np.prod(p + 1) for n in RSM_POLYS for c, p in zip(m[n], powers[n], strict=True)):
            raise ValueError("wrong number of coefficients")
        value = {n: _rsm_value(_rsm_rows(m[n])[of], powers[n][of], q) for n in RSM_POLYS}
        pixel = [value[f"{a}n"] / value[f"{a}d"] * v[f"{w}_scale"] + v[f"{w}_off"] for a, w in (("c", "col"), ("r", "row"))]
    return pa.StructArray.from_arrays([pa.array(np.where(np.isfinite(p), p, np.nan), from_pandas=True) for p in pixel], ["x", "y"])


def _ecef(lon: np.ndarray, lat: np.ndarray, h: np.ndarray) -> np.ndarray:
    n = G.A / np.sqrt(1 - G.E2 * np.sin(lat) ** 2)
    return np.stack([(n + h) * np.cos(lat) * np.cos(lon), (n + h) * np.cos(lat) * np.sin(lon), (n * (1 - G.E2) + h) * np.sin(lat)], 1)


def _geodetic(places: np.ndarray) -> np.ndarray:
    """Longitude, latitude and elevation of Earth-centred places, as ecef_to_geodetic."""
    x, y, z = places.T
    p = np.hypot(x, y)
    beta = np.arctan2(G.A * z, G.B * p)
    for _ in range(3):
        lat = np.arctan2(z + G.EP2 * G.B * np.sin(beta) ** 3, p - G.E2 * G.A * np.cos(beta) ** 3)
        beta = np.arctan2((1 - G.FLATTENING) * np.sin(lat), np.cos(lat))
    s, c = np.sin(lat), np.cos(lat)
    return np.stack([np.arctan2(y, x), lat, p * c + z * s - G.A * np.sqrt(1 - G.E2 * s * s)], 1)


def rsm_image_to_world(df: DataFrame, models: DataFrame, key: str = "image_id", x: str = "x", y: str = "y", height: str | None = "height") -> DataFrame:
    """Rows with lon_deg, lat_deg, height and the residual in pixels, by the model of the pixel's section; rows of images without model are absent.

    Where a row has no height, the model's own is taken.  Newton steps with a difference quotient from the middle of
    V1 and V4 stay within the box of the vertices: a step that leaves it is replaced by the best one along the bound.
    """
    names = ["lon_deg", "lat_deg", "height", "residual"]
    kept = [n for n in df.columns if n not in names]
    images = models.where("section_row = 0 and section_col = 0").select(key, F.struct(*RSM_IMAGE).alias("_image"))
    row, col = section_index(F.col(y), F.col(x), F.col("_image").getField)
    rows = df.join(images, key).withColumns({"_row": row, "_col": col})
    model = models.select(key, F.col("section_row").alias("_row"), F.col("section_col").alias("_col"), F.struct(*RSM_SECTION, "form", F.array("origin.x", "origin.y", "origin.z").alias("origin"), F.flatten("axes").alias("axes"), "box", "start", "height").alias("_m"))
    m = F.col("_m").getField
    given = F.lit(None).cast("double") if height is None else F.col(height).cast("double")
    rows = rows.join(model, [key, "_row", "_col"]).select(*kept, _section_name(key).alias("_name"), F.col(x).cast("double").alias("_samp"), F.col(y).cast("double").alias("_line"), defaulted_elevation(given, m("height")).alias("_h"), "_m")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.select(*kept).schema.fields)}, {', '.join(f'{n} double' for n in names)}"

    def solve(b: pa.RecordBatch) -> np.ndarray:
        m, of = _sections(b.column("_name"), b.column("_m"))
        number = lambda n: b.column(n).to_numpy(zero_copy_only=False).astype(float)
        v = {n: m[n].to_numpy(float)[of] for n in RSM_NORMS}
        c, powers = {n: _rsm_rows(m[n])[of] for n in RSM_POLYS}, {n: np.stack(m[f"{n}_powers"].to_numpy()).astype(int)[of] for n in RSM_POLYS}
        form, h, box = m["form"].to_numpy()[of], number("_h"), np.stack(m["box"].to_numpy()).astype(float)[of]
        want = np.stack([number("_samp"), number("_line")], 1)
        flat, turned = form == "R", m["form"].to_numpy() == "R"
        origin, axes = np.zeros((len(turned), 3)), np.zeros((len(turned), 9))
        if turned.any():
            origin[turned], axes[turned] = np.stack(m["origin"].to_numpy()[turned]).astype(float), np.stack(m["axes"].to_numpy()[turned]).astype(float)
        origin, axes = origin[of], axes.reshape(-1, 3, 3)[of]
        off, scale = np.stack([v[f"{n}_off"] for n in "xyz"], 1), np.stack([v[f"{n}_scale"] for n in "xyz"], 1)

        def image(q: np.ndarray) -> np.ndarray:
            d = np.stack([np.where(form == "H", np.mod(q[:, 0], 2 * np.pi), q[:, 0]), q[:, 1], h], 1)
            if flat.any():
                d[flat] = np.einsum("nij,nj->ni", axes[flat], _ecef(q[flat, 0], q[flat, 1], h[flat]) - origin[flat])
            d = (d - off) / scale
            value = {n: _rsm_value(c[n], powers[n], d) for n in RSM_POLYS}
            return np.stack([value["cn"] / value["cd"] * v["col_scale"] + v["col_off"], value["rn"] / value["rd"] * v["row_scale"] + v["row_off"]], 1)

        low, high = box[:, :2], box[:, 2:]
        size = np.maximum(high - low, 1e-12)
        q = np.clip(np.stack(m["start"].to_numpy()).astype(float)[of], low, high)
        best, miss = q, image(q) - want
        least = np.hypot(*miss.T)
        for _ in range(RSM_STEPS):
            if not (least > RSM_LIMIT).any():
                break
            e = 1e-5 * size
            jac = np.stack([(image(q + e * u) - image(q - e * u)) / (2 * e * u).sum(1)[:, None] for u in (np.array([1.0, 0]), np.array([0, 1.0]))], 2)
            a, d = jac[:, :, 0], jac[:, :, 1]
            det = a[:, 0] * d[:, 1] - a[:, 1] * d[:, 0]
            step = -np.stack([(miss[:, 0] * d[:, 1] - miss[:, 1] * d[:, 0]) / det, (a[:, 0] * miss[:, 1] - a[:, 1] * miss[:, 0]) / det], 1)
            inside = ((q + step >= low) & (q + step <= high)).all(1)
            bounded, left = np.clip(q + step, low, high) - q, np.full(len(q), np.inf)
            for k in (0, 1):  # one coordinate on the bound that the step passes, the other where it is best then
                trial = bounded.copy()
                rest = miss + jac[:, :, k] * trial[:, k : k + 1]
                o = 1 - k
                trial[:, o] = np.clip(q[:, o] - (jac[:, :, o] * rest).sum(1) / (jac[:, :, o] ** 2).sum(1), low[:, o], high[:, o]) - q[:, o]
                size_left = np.hypot(*(rest + jac[:, :, o] * trial[:, o : o + 1]).T)
                take = ~inside & (size_left < left)
                left = np.where(take, size_left, left)
                step = np.where(take[:, None], trial, step)
            q = np.clip(q + np.where(np.isfinite(step), step, 0), low, high)
            miss = image(q) - want
            now = np.hypot(*miss.T)
            better = now < least
            best, least = np.where(better[:, None], q, best), np.where(better, now, least)
        lon, lat = best.T
        return np.stack([np.degrees(np.mod(lon + np.pi, 2 * np.pi) - np.pi), np.degrees(lat), h, least], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with np.errstate(all="ignore"):
                found = solve(b) if b.num_rows else np.zeros((0, 4))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), *(pa.array(v, from_pandas=True) for v in np.ascontiguousarray(found.T))], [*kept, *names])

    return rows.mapInArrow(run, schema)


# Combinations.


def through_chip(chip: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """Chip pixel to full image by the homography from full to chip."""
    return M.homography_inverse(chip, x, y)


def to_chip(chip: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    return M.homography(chip, x, y)


def defaulted_elevation(elev: Column, default: Column) -> Column:
    """A place's own elevation unless it is missing or not a number."""
    return F.when(elev.isNull() | F.isnan(elev), default).otherwise(elev)


def options(given: Column, defaults: Column) -> Column:
    """Maps of options, the given ones winning."""
    kept = F.map_filter(defaults, lambda k, v: ~F.map_contains_key(F.coalesce(given, F.create_map().cast("map<string,string>")), k))
    return F.map_concat(kept, F.coalesce(given, F.create_map().cast("map<string,string>")))


#: Fixed precedence: later kinds replace earlier ones in each slot.
APPROXIMATE, PRECISE = ["AFFINE", "GCP", "CSCRNA"], ["RPC", "RSM", "SICD", "SIDD"]


def choose_models(available: DataFrame, key: str = "image_id", kind: str = "kind") -> DataFrame:
    """Approximate, precise and combined kind of each image from rows of what can be built."""
    rank = lambda kinds: F.max(F.when(F.col(kind).isin(kinds), F.struct(sum((F.when(F.col(kind) == k, F.lit(i)).otherwise(0) for i, k in enumerate(kinds)), F.lit(0)).alias("r"), F.col(kind).alias("k"))))["k"]
    rows = available.groupBy(key).agg(rank(APPROXIMATE).alias("approximate"), rank(PRECISE).alias("precise"))
    return rows.withColumn("model", F.when(F.col("approximate").isNotNull() & F.col("precise").isNotNull(), "COMPOSITE").otherwise(F.coalesce("precise", "approximate")))
