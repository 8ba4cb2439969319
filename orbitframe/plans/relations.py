"""Imagery relations derived from the driver's tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PTS = "SELECT o_orderkey, o_custkey, ((o_orderkey * 7919) % 360000) / 1e3 - 180 AS lon_deg, ((o_custkey * 104729) % 160000) / 1e3 - 80 AS lat_deg, floor(o_totalprice) % 9000 AS elev FROM orders"
PIX = "SELECT l_suppkey % 8 AS image, l_linenumber AS band, l_orderkey % 512 AS x, l_partkey % 512 AS y, l_quantity * 5 AS v FROM lineitem"
BOXES = "SELECT c_custkey, CAST((c_custkey * 37) % 4096 AS DOUBLE) AS xmin, CAST((c_custkey * 91) % 4096 AS DOUBLE) AS ymin, CAST((c_custkey * 37) % 4096 + 5 + c_custkey % 36 AS DOUBLE) AS xmax, CAST((c_custkey * 91) % 4096 + 5 + (c_custkey * 7) % 36 AS DOUBLE) AS ymax FROM customer"
PROBES = "SELECT s_suppkey, CAST((s_suppkey * 57) % 4096 AS DOUBLE) AS xmin, CAST((s_suppkey * 131) % 4096 AS DOUBLE) AS ymin, CAST((s_suppkey * 57) % 4096 + 30 AS DOUBLE) AS xmax, CAST((s_suppkey * 131) % 4096 + 30 AS DOUBLE) AS ymax FROM supplier"


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lon = (F.col("o_orderkey") * 7919 % 360000) / 1e3 - 180
    lat = (F.col("o_custkey") * 104729 % 160000) / 1e3 - 80
    return rows.select("o_orderkey", "o_custkey", lon.alias("lon_deg"), lat.alias("lat_deg"), (F.floor("o_totalprice") % 9000).cast("double").alias("elev"))


def pix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select((F.col("l_suppkey") % 8).alias("image"), F.col("l_linenumber").alias("band"), (F.col("l_orderkey") % 512).alias("x"), (F.col("l_partkey") % 512).alias("y"), (F.col("l_quantity") * 5).alias("v"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    x, y = (k * 37) % 4096, (k * 91) % 4096
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", x.cast("double").alias("xmin"), y.cast("double").alias("ymin"), (x + 5 + k % 36).cast("double").alias("xmax"), (y + 5 + (k * 7) % 36).cast("double").alias("ymax"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = (k * 57) % 4096, (k * 131) % 4096
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", x.cast("double").alias("xmin"), y.cast("double").alias("ymin"), (x + 30).cast("double").alias("xmax"), (y + 30).cast("double").alias("ymax"))


#: A text for rounding that both engines compute alike.
def cut(column, digits: int = 6):
    k = 10.0**digits
    return F.floor(column * k + 0.5) / k


def cut_sql(text: str, digits: int = 6) -> str:
    k = f"1e{digits}"
    return f"floor(({text}) * {k} + 0.5) / {k}"
