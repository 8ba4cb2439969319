"""Exact predicates between geometries of all kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.operators import geometries
from orbitframe.plans.relations import cut, cut_sql

REACH = 40.0


def _text(kind: str, *places: tuple[Column, Column]) -> Column:
    number = lambda c: c.cast("string")
    pairs = [F.concat(F.lit("["), number(x), F.lit(","), number(y), F.lit("]")) for x, y in places]
    inner = F.concat_ws(",", *pairs)
    open_, close = {"Point": ("", ""), "LineString": ("[", "]"), "Polygon": ("[[", "]]")}[kind]
    return F.concat(F.lit(f'{{"type":"{kind}","coordinates":{open_}'), inner, F.lit(f"{close}}}"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle, a line or a point for each customer, as GeoJSON; every seventh is nested in two collections."""
    k = F.col("c_custkey")
    x, y, w, h = k * 37 % 4096, k * 91 % 4096, 5 + k % 36, 5 + k * 7 % 36
    plain = F.when(k % 3 == 0, _text("Polygon", (x, y), (x + w, y + 1), (x + 2, y + h), (x, y))).when(k % 3 == 1, _text("LineString", (x, y), (x + w, y + h))).otherwise(_text("Point", (x, y)))
    nested = F.concat(F.lit('{"type":"GeometryCollection","geometries":[{"type":"GeometryCollection","geometries":['), plain, F.lit("]}]}"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.when(k % 7 == 0, nested).otherwise(plain).alias("geometry"))


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle or a line for each supplier; the first's holds all of the plane in use."""
    k = F.col("s_suppkey")
    x, y = k * 57 % 4096, k * 131 % 4096
    wide = [(F.lit(a), F.lit(b)) for a, b in ((-10, -10), (9000, -10), (-10, 9000), (-10, -10))]
    shape = F.when(k == 1, _text("Polygon", *wide)).when(k % 2 == 1, _text("LineString", (x, y), (x + 60, y + 25))).otherwise(_text("Polygon", (x, y), (x + 70, y + 5), (x + 20, y + 60), (x, y)))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", shape.alias("geometry"))


def intersects_geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometries.intersecting(features(spark, sf_dir), queries_of(spark, sf_dir), "c_custkey", "s_suppkey", size=16.0)


def nearest_geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = geometries.nearest(features(spark, sf_dir), queries_of(spark, sf_dir), "c_custkey", "s_suppkey", REACH, size=16.0)
    return got.select("c_custkey", "s_suppkey", cut(F.col("distance"), 6).alias("distance"))


_F = "SELECT c_custkey AS id, c_custkey % 3 AS kind, c_custkey * 37 % 4096 AS x, c_custkey * 91 % 4096 AS y, 5 + c_custkey % 36 AS w, 5 + c_custkey * 7 % 36 AS h FROM customer"
_Q = "SELECT s_suppkey AS id, CASE WHEN s_suppkey = 1 THEN 2 ELSE s_suppkey % 2 END AS kind, s_suppkey * 57 % 4096 AS x, s_suppkey * 131 % 4096 AS y FROM supplier"


def _edges_sql(source: str, shapes: dict[int, list[tuple[str, str]]]) -> str:
    rows = [f"SELECT id, kind, {i} AS i, CAST({a[0]} AS DOUBLE) AS ax, CAST({a[1]} AS DOUBLE) AS ay, CAST({b[0]} AS DOUBLE) AS bx, CAST({b[1]} AS DOUBLE) AS by_ FROM ({source}) WHERE kind = {kind}" for kind, places in shapes.items() for i, (a, b) in enumerate(zip(places, places[1:] if len(places) > 1 else places, strict=False))]
    return " UNION ALL ".join(rows)


_FE = _edges_sql(_F, {0: [("x", "y"), ("x + w", "y + 1"), ("x + 2", "y + h"), ("x", "y")], 1: [("x", "y"), ("x + w", "y + h")], 2: [("x", "y")]})
_QE = _edges_sql(_Q, {2: [("-10", "-10"), ("9000", "-10"), ("-10", "9000"), ("-10", "-10")], 1: [("x", "y"), ("x + 60", "y + 25")], 0: [("x", "y"), ("x + 70", "y + 5"), ("x + 20", "y + 60"), ("x", "y")]})
_turn = lambda a, b, p: f"sign(({b[0]} - {a[0]}) * ({p[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({p[0]} - {a[0]}))"
_fa, _fb, _qa, _qb = ("f.ax", "f.ay"), ("f.bx", "f.by_"), ("q.ax", "q.ay"), ("q.bx", "q.by_")
_MEET = (
    f"({_turn(_fa, _fb, _qa)} * {_turn(_fa, _fb, _qb)} <= 0 AND {_turn(_qa, _qb, _fa)} * {_turn(_qa, _qb, _fb)} <= 0 AND least(f.ax, f.bx) <= greatest(q.ax, q.bx) AND least(q.ax, q.bx) <= greatest(f.ax, f.bx) "
    "AND least(f.ay, f.by_) <= greatest(q.ay, q.by_) AND least(q.ay, q.by_) <= greatest(f.ay, f.by_))"
)
_ray = lambda e, p: f"sum(CASE WHEN ({e}.ay > {p}.ay) <> ({e}.by_ > {p}.ay) AND {p}.ax < {e}.ax + ({e}.bx - {e}.ax) * ({p}.ay - {e}.ay) / nullif({e}.by_ - {e}.ay, 0) THEN 1 ELSE 0 END) % 2 = 1"
_INSIDE = f"""SELECT p.id AS c_custkey, e.id AS s_suppkey FROM (SELECT * FROM ({_FE}) WHERE i = 0) p, ({_QE}) e WHERE e.kind <> 1 GROUP BY 1, 2 HAVING {_ray('e', 'p')}
UNION ALL SELECT e.id, p.id FROM (SELECT * FROM ({_QE}) WHERE i = 0) p, ({_FE}) e WHERE e.kind = 0 GROUP BY 1, 2 HAVING {_ray('e', 'p')}"""


def _apart(p: tuple[str, str], a: tuple[str, str], b: tuple[str, str]) -> str:
    dx, dy = f"({b[0]} - {a[0]})", f"({b[1]} - {a[1]})"
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce((({p[0]} - {a[0]}) * {dx} + ({p[1]} - {a[1]}) * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0), 0.0::DOUBLE)))"
    return f"pow({p[0]} - {a[0]} - {t} * {dx}, 2) + pow({p[1]} - {a[1]} - {t} * {dy}, 2)"


_DISTANCE = f"CASE WHEN {_MEET} THEN 0.0::DOUBLE ELSE sqrt(least({_apart(_fa, _qa, _qb)}, {_apart(_fb, _qa, _qb)}, {_apart(_qa, _fa, _fb)}, {_apart(_qb, _fa, _fb)})) END"
_PAIRS = f"SELECT c_custkey, s_suppkey, min(d) AS d FROM (SELECT f.id AS c_custkey, q.id AS s_suppkey, {_DISTANCE} AS d FROM ({_FE}) f, ({_QE}) q UNION ALL SELECT *, 0.0::DOUBLE FROM ({_INSIDE})) WHERE d <= {REACH} GROUP BY 1, 2"

QUERIES = {"intersects_geometries": intersects_geometries, "nearest_geometries": nearest_geometries}
ORACLES = {
    "intersects_geometries": f"SELECT DISTINCT c_custkey, s_suppkey FROM (SELECT f.id AS c_custkey, q.id AS s_suppkey FROM ({_FE}) f, ({_QE}) q WHERE {_MEET} UNION ALL {_INSIDE})",
    "nearest_geometries": f"SELECT c_custkey, s_suppkey, {cut_sql('d', 6)} AS distance FROM (SELECT *, min(d) OVER (PARTITION BY s_suppkey) AS least_ FROM ({_PAIRS})) WHERE d = least_",
}
