"""Map projections against published examples and round trips."""

import pytest
from pyspark.sql import functions as F

from orbitframe.functions import projections as J

WGS = 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]'


def old(name, body, axis, inverse, unit=1.0, **values):
    numbers = "".join(f',PARAMETER["{k}",{v}]' for k, v in values.items())
    return f'PROJCS["x",GEOGCS["y",DATUM["z",SPHEROID["s",{axis},{inverse}]],UNIT["degree",0.0174532925199433]],PROJECTION["{name}"]{numbers},UNIT["u",{unit}]{body}]'


FOOT = 0.304800609601219
#: Worked examples of the geodesy registry's guidance note: system, longitude, latitude, east, north.
PUBLISHED = [
    (old("Transverse_Mercator", "", 6377563.396, 299.32496, latitude_of_origin=49, central_meridian=-2, scale_factor=0.9996012717, false_easting=400000, false_northing=-100000), 0.5, 50.5, 577274.99, 69740.50),
    (old("Lambert_Conformal_Conic_2SP", "", 6378206.4, 294.978698213898, FOOT, latitude_of_origin=27 + 50 / 60, central_meridian=-99, standard_parallel_1=28 + 23 / 60, standard_parallel_2=30 + 17 / 60, false_easting=2000000, false_northing=0), -96, 28.5, 2963503.91, 254759.80),
    (old("Lambert_Conformal_Conic_1SP", "", 6378206.4, 294.978698213898, latitude_of_origin=18, central_meridian=-77, scale_factor=1, false_easting=250000, false_northing=150000), -(76 + 56 / 60 + 37.26 / 3600), 17 + 55 / 60 + 55.80 / 3600, 255966.58, 142493.51),
    ("EPSG:5041", 44, 73, 3320416.75, 632668.43),
    (old("Polar_Stereographic", "", 6378137, 298.257223563, latitude_of_origin=-71, central_meridian=70, false_easting=6000000, false_northing=6000000), 120, -75, 7255380.79, 7053389.56),
    (old("Mercator_1SP", "", 6377397.155, 299.15281, central_meridian=110, scale_factor=0.997, false_easting=3900000, false_northing=900000), 120, -3, 5009726.58, 569150.82),
]


def test_published_examples(spark):
    rows = J.constants(spark.createDataFrame([(i, r[0], *map(float, r[1:])) for i, r in enumerate(PUBLISHED)], "i int, crs string, lon double, lat double, e double, n double"))
    for r in J.unproject(J.project(rows, "lon", "lat"), "east", "north").collect():
        assert (r.east, r.north) == pytest.approx((r.e, r.n), abs=0.011 if r.i != 1 else 0.02)
        assert (r.lon_deg, r.lat_deg) == pytest.approx((r.lon, r.lat), abs=1e-9)


def test_round_trips_over_the_globe(spark):
    codes = ["EPSG:4326", "EPSG:3857", "EPSG:3395", "EPSG:32631", "EPSG:32760", "EPSG:5041", "EPSG:5042", "EPSG:3031", "EPSG:3413", "EPSG:3995", None, "", WGS]
    systems = J.constants(spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, crs string"))
    places = spark.range(400).select((F.col("id") % 20 * 18 - 179.5).alias("lon"), (F.floor(F.col("id") / 20) * 8 - 76.25).alias("lat"))
    rows = systems.crossJoin(places)
    near = (F.col("system.kind") != "TM") | (F.abs(F.pmod(F.col("lon") - F.degrees("system.lon0") + 180, F.lit(360.0)) - 180) < 30)
    got = J.unproject(J.project(rows.where(near), "lon", "lat"), "east", "north").select("i", "lon", "lat", "lon_deg", "lat_deg").collect()
    assert len(got) > 2500
    for r in got:
        assert (r.lon_deg, r.lat_deg) == pytest.approx((r.lon, r.lat), abs=1e-8), r


def test_second_version_and_poles(spark):
    text = 'PROJCRS["UTM 31N",BASEGEOGCRS["WGS 84",DATUM["x",ELLIPSOID["WGS 84",6378137,298.257223563,LENGTHUNIT["metre",1]]]],CONVERSION["c",METHOD["Transverse Mercator",ID["EPSG",9807]],PARAMETER["Latitude of natural origin",0,ANGLEUNIT["degree",0.0174532925199433]],PARAMETER["Longitude of natural origin",3,ANGLEUNIT["degree",0.0174532925199433]],PARAMETER["Scale factor at natural origin",0.9996,SCALEUNIT["unity",1]],PARAMETER["False easting",500000,LENGTHUNIT["metre",1]],PARAMETER["False northing",0,LENGTHUNIT["metre",1]]],CS[Cartesian,2]]'
    rows = J.constants(spark.createDataFrame([(text,), ("EPSG:32631",)], "crs string")).withColumns({"lon": F.lit(4.25), "lat": F.lit(51.5)})
    a, b = J.project(rows, "lon", "lat").collect()
    assert (a.east, a.north) == pytest.approx((b.east, b.north), abs=1e-6)
    pole = J.constants(spark.createDataFrame([("EPSG:5042",)], "crs string")).withColumns({"x": F.lit(2e6), "y": F.lit(2e6)})
    assert J.unproject(pole, "x", "y").first().lat_deg == -90


@pytest.mark.parametrize("text", ["EPSG:99999", "nothing known", old("Oblique_Cylinder", "", 6378137, 298.25), 'PROJCS["x",PROJECTION["Transverse_Mercator"]]'])
def test_unknown_systems_are_errors(spark, text):
    with pytest.raises(Exception, match="unknown reference system"):
        J.constants(spark.createDataFrame([(text,)], "crs string")).collect()


def test_projected_by_batches():
    """Rows of all kinds, and one without a system, in one batch; what is asked of the result doesn't project again."""
    import numpy as np
    import pyarrow as pa

    names = ["kind", "e", "axis", "lon0", "east", "north", "unit", "alpha", "beta", "radius", "xi0", "south", "rho", "cone", "big", "rho0"]
    flat = dict.fromkeys(names) | {"kind": "GEOGRAPHIC"}
    sphere = dict.fromkeys(names) | {"kind": "SPHERE", "axis": 6378137.0, "lon0": 0.0, "east": 10.0, "north": 20.0, "unit": 1.0}
    of = pa.struct([(n, pa.string() if n == "kind" else pa.bool_() if n == "south" else pa.list_(pa.float64()) if n in ("alpha", "beta") else pa.float64()) for n in names])
    got = J._projected(pa.array([3.0, 90.0, 1.0]), pa.array([4.0, 0.0, 1.0]), pa.array([flat, sphere, None], of)).to_pylist()
    assert got[0] == {"east": 3.0, "north": 4.0} and got[2] == {"east": None, "north": None}
    assert np.isclose(got[1]["east"], 6378137.0 * np.pi / 2 + 10) and np.isclose(got[1]["north"], 20.0)
