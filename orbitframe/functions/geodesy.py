"""WGS-84 coordinates as columns; angles in radians, lengths in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of WGS-84.
A = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
B = A * (1 - FLATTENING)
EP2 = E2 / (1 - E2)
PI = math.pi

Triple = tuple[Column, Column, Column]


def floor_mod(x: Column, m: float) -> Column:
    """Remainder with the divisor's sign, as Python's %."""
    return x - F.lit(m) * F.floor(x / F.lit(m))


def geodetic_to_ecef(lon: Column, lat: Column, elev: Column) -> Triple:
    n = F.lit(A) / F.sqrt(1 - F.lit(E2) * F.sin(lat) * F.sin(lat))
    return (n + elev) * F.cos(lat) * F.cos(lon), (n + elev) * F.cos(lat) * F.sin(lon), (n * (1 - E2) + elev) * F.sin(lat)


def ecef_to_geodetic(x: Column, y: Column, z: Column) -> Triple:
    """Longitude, latitude, elevation; a parametric latitude refined twice is exact to double precision."""
    p = F.sqrt(x * x + y * y)
    beta = F.atan2(F.lit(A) * z, F.lit(B) * p)
    lat = _latitude(p, z, beta)
    for _ in range(2):
        beta = F.atan2(F.lit(1 - FLATTENING) * F.sin(lat), F.cos(lat))
        lat = _latitude(p, z, beta)
    s, c = F.sin(lat), F.cos(lat)
    n = F.lit(A) / F.sqrt(1 - F.lit(E2) * s * s)
    # stable everywhere, also at the poles
    elev = p * c + z * s - F.lit(A) * F.lit(A) / n
    return F.atan2(y, x), lat, elev


def _latitude(p: Column, z: Column, beta: Column) -> Column:
    return F.atan2(z + F.lit(EP2 * B) * F.pow(F.sin(beta), F.lit(3.0)), p - F.lit(E2 * A) * F.pow(F.cos(beta), F.lit(3.0)))


def normalized(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Latitude within a quarter turn, longitude in [-pi, pi); going over a pole turns the longitude by half a turn."""
    turned = floor_mod(lat + PI, 2 * PI) - PI
    over = F.abs(turned) > PI / 2
    return floor_mod(lon + F.when(over, F.lit(PI)).otherwise(F.lit(0.0)) + PI, 2 * PI) - PI, F.when(over, F.signum(turned) * PI - turned).otherwise(turned)


def range_adjusted(lon: Column, lat: Column, min_lon: float, max_lon: float, min_lat: float, max_lat: float) -> Column:
    """Struct lon, lat of the same place within the given ranges; null where none of its representations fits."""
    turn = 2 * PI
    lon, lat = normalized(lon, lat)
    up = lambda v, least: v + F.ceil((F.lit(least) - v) / turn) * turn
    near = up(lon, min_lon)
    past = near > max_lon
    lon1 = F.when(past, near - PI).otherwise(near)
    lat1 = F.when(past, PI - lat).otherwise(lat)
    lat2 = up(lat1, min_lat)
    flip = lat2 > max_lat
    lon3 = F.when(flip, up(lon1 + PI, min_lon)).otherwise(lon1)
    lat3 = F.when(flip, up(PI - lat1, min_lat)).otherwise(lat2)
    fits = ~(past & (lon1 < min_lon)) & ~(flip & ((lon3 > max_lon) | (lat3 > max_lat)))
    return F.when(fits, F.struct(lon3.alias("lon"), lat3.alias("lat")))


def _parts(degrees: Column) -> tuple[Column, Column, Column]:
    """Whole degrees, minutes and seconds; each remainder is rounded to six decimals and then cut."""
    size = F.abs(degrees)
    d = F.floor(F.round(size, 6))
    # Python's int() cuts toward zero, also the slightly negative remainders that rounding up leaves
    cut = lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))
    m = cut(F.round(size - d, 6) * 60)
    s = cut(F.round(size - d - m / 60.0, 6) * 3600)
    return d, m, s


def _pad(value: Column, width: int) -> Column:
    text = value.cast("long").cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def format_coordinate(spec: str, lon: Column, lat: Column, elev: Column) -> Column:
    """Text of a coordinate by a directive string, which is compiled once here into one concat.

    %L %O radians, %l %o degrees, each of %l and %o with d, m, s, h or H for degrees, minutes, seconds and the
    hemisphere's letter; %E elevation, %% a percent sign; other directives give nothing.
    """
    lat_deg, lon_deg = F.degrees(lat), F.degrees(lon)
    cells: dict[str, Column] = {"L": lat.cast("string"), "O": lon.cast("string"), "l": F.abs(lat_deg).cast("string"), "o": F.abs(lon_deg).cast("string"), "E": elev.cast("string"), "%": F.lit("%")}
    for letter, value, width, signs in (("l", lat_deg, 2, "NS"), ("o", lon_deg, 3, "EW")):
        d, m, s = _parts(value)
        side = F.when(value < 0, F.lit(signs[1])).otherwise(F.lit(signs[0]))
        cells |= {letter + "d": _pad(d, width), letter + "m": _pad(m, 2), letter + "s": _pad(s, 2), letter + "H": side, letter + "h": F.lower(side)}
    out, i = [], 0
    while i < len(spec):
        if spec[i] != "%" or i + 1 == len(spec):
            out.append(F.lit(spec[i]))
            i += 1
        elif spec[i + 1 : i + 3] in cells and len(spec[i + 1 : i + 3]) == 2:
            out.append(cells[spec[i + 1 : i + 3]])
            i += 3
        else:
            if spec[i + 1] in cells:
                out.append(cells[spec[i + 1]])
            i += 2
    return F.concat(*out) if out else F.lit("")


def dms(lon: Column, lat: Column) -> Column:
    """Fifteen characters: latitude, then longitude, in degrees, minutes and seconds."""
    return format_coordinate("%ld%lm%ls%lH%od%om%os%oH", lon, lat, F.lit(0.0))


def geolocation_corners(corners: list[tuple[Column, Column]]) -> Column:
    """Four corners as sixty characters."""
    return F.concat(*(dms(lon, lat) for lon, lat in corners))


def up_vector(lon: Column, lat: Column) -> Triple:
    """Unit vector of increasing height."""
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)
