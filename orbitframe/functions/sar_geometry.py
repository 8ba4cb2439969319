"""Synthetic-aperture image geometry as columns: image plane, range and range-rate contours, ground planes.

The computations follow the public image projection standard for complex SAR data.  Vectors are triples of
columns; a place without a solution is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.functions import polynomials as P

Vector = tuple[Column, Column, Column]


def add(a: Vector, b: Vector) -> Vector:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(a: Vector, k: Column) -> Vector:
    return tuple(x * k for x in a)


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> Vector:
    n = norm(a)
    return tuple(F.try_divide(x, n) for x in a)


def packed(a: Vector) -> Column:
    return F.struct(a[0].alias("x"), a[1].alias("y"), a[2].alias("z"))


def unpacked(c: Column) -> Vector:
    return c["x"], c["y"], c["z"]


def literal(values) -> Vector:
    return tuple(F.lit(float(v)) for v in values)


def spread(df: DataFrame, **vectors: Vector) -> tuple[DataFrame, dict[str, Vector]]:
    """Vectors as columns of one number each, so that what is built on them works each out once.

    A column that packs them would be taken apart by the optimizer, which repeats each number wherever it is used.
    """
    df = df.withColumns({f"_{n}_{a}": v for n, vector in vectors.items() for a, v in zip("xyz", vector, strict=True)})
    return df, {n: tuple(F.col(f"_{n}_{a}") for a in "xyz") for n in vectors}


# Image plane.


def row_col_to_plane(row: Column, col: Column, scp_row: Column, scp_col: Column, row_ss: Column, col_ss: Column) -> tuple[Column, Column]:
    """Metres from the scene centre point along rows and columns."""
    return (row - scp_row) * row_ss, (col - scp_col) * col_ss


def plane_to_row_col(x: Column, y: Column, scp_row: Column, scp_col: Column, row_ss: Column, col_ss: Column) -> tuple[Column, Column]:
    return x / row_ss + scp_row, y / col_ss + scp_col


def plane_point(x: Column, y: Column, scp: Vector, u_row: Vector, u_col: Vector) -> Vector:
    return add(scp, add(scale(u_row, x), scale(u_col, y)))


def point_to_plane(p: Vector, scp: Vector, u_row: Vector, u_col: Vector) -> tuple[Column, Column]:
    """Inverse of plane_point; the two directions need not be at right angles."""
    d = sub(p, scp)
    c = dot(u_row, u_col)
    a, b = dot(d, u_row), dot(d, u_col)
    w = 1 - c * c
    return (a - c * b) / w, (b - c * a) / w


# Range and range rate at the centre of aperture.


def state(arp: tuple[Column, Column, Column], t: Column) -> tuple[Vector, Vector]:
    """Position and velocity at a time from the position's polynomials."""
    return P.vector(*arp, t), P.vector(*(P.derivative(c) for c in arp), t)


def _to_scp(arp: Vector, varp: Vector, scp: Vector) -> tuple[Column, Column]:
    d = sub(arp, scp)
    r = norm(d)
    return r, dot(varp, d) / r


def polar_format(rg: Column, az: Column, t: Column, arp: Vector, varp: Vector, scp: Vector, polar: Column, factor: Column) -> tuple[Column, Column]:
    r, rdot = _to_scp(arp, varp, scp)
    theta, theta_dot = P.horner(polar, t), P.horner(P.derivative(polar), t)
    k, k_dot = P.horner(factor, theta), P.horner(P.derivative(factor), theta)
    along, across = rg * F.cos(theta) + az * F.sin(theta), az * F.cos(theta) - rg * F.sin(theta)
    return r + k * along, rdot + (k_dot * along + k * across) * theta_dot


def range_azimuth_compressed(rg: Column, az: Column, arp: Vector, varp: Vector, scp: Vector, az_factor: Column) -> tuple[Column, Column]:
    r, rdot = _to_scp(arp, varp, scp)
    return r + rg, rdot - norm(varp) * az_factor * az


def imaging_near_closest_approach(rg: Column, az: Column, t: Column, arp_poly: tuple[Column, Column, Column], r_ca: Column, time_ca: Column, rate: Column) -> tuple[Column, Column]:
    t_ca = P.horner(time_ca, az)
    v_ca = P.vector(*(P.derivative(c) for c in arp_poly), t_ca)
    v2, dt, f = dot(v_ca, v_ca), t - t_ca, P.surface(rate, rg, az)
    r = F.sqrt((r_ca + rg) * (r_ca + rg) + f * v2 * dt * dt)
    return r, f / r * v2 * dt


def uniform_plane(x: Column, y: Column, arp: Vector, varp: Vector, scp: Vector, u_row: Vector, u_col: Vector) -> tuple[Column, Column]:
    d = sub(arp, plane_point(x, y, scp, u_row, u_col))
    r = norm(d)
    return r, dot(varp, d) / r


def adjusted(r: Column, arp: Vector, varp: Vector, bias: Column, d_arp: Vector, d_varp: Vector) -> tuple[Column, Vector, Vector]:
    """Range, position and velocity with adjustable offsets."""
    return r + bias, add(arp, d_arp), add(varp, d_varp)


# Surfaces.


def contour_on_plane(r: Column, rdot: Column, arp: Vector, varp: Vector, ref: Vector, normal: Vector) -> Column:
    """Struct x, y, z where the contour meets a plane on the side of the reference point; null without a solution."""
    z = unit(normal)
    height = dot(sub(arp, ref), z)
    ground = F.sqrt(F.greatest(r * r - height * height, F.lit(0.0)))
    v_z = dot(varp, z)
    v_x = F.sqrt(dot(varp, varp) - v_z * v_z)
    x = scale(sub(varp, scale(z, v_z)), 1 / v_x)
    y = cross(z, x)
    cos_az = F.try_divide(v_z * height / r - rdot, v_x * ground / r)
    look = F.signum(dot(cross(sub(arp, ref), varp), z))
    sin_az = look * F.sqrt(F.greatest(1 - cos_az * cos_az, F.lit(0.0)))
    point = add(sub(arp, scale(z, height)), add(scale(x, ground * cos_az), scale(y, ground * sin_az)))
    return F.when((height <= r) & (F.abs(cos_az) <= 1), packed(point))


def side_of_track(scp: Vector, arp: Vector, varp: Vector) -> Column:
    """L or R: on which side of the flight path the scene lies."""
    up = unit(arp)
    flat = lambda v: sub(v, scale(up, dot(v, up)))
    return F.when(dot(cross(flat(varp), flat(sub(scp, arp))), up) >= 0, "L").otherwise("R")


def slant_normal(scp: Vector, arp: Vector, varp: Vector, side: Column) -> Vector:
    n = unit(cross(varp, sub(scp, arp)))
    return scale(n, F.when(side == "R", -1.0).otherwise(1.0))


def image_normal(scp: Vector, u_row: Vector, u_col: Vector) -> Vector:
    """Normal of the image plane that points away from the earth's centre."""
    n = unit(cross(u_row, u_col))
    return scale(n, F.when(dot(n, scp) < 0, -1.0).otherwise(1.0))
