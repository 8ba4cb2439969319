"""The query over images of all kinds on rows that its tables at small scale lack."""

import duckdb
import pytest
from pyspark.sql import functions as F

from orbitframe.plans import mixed

#: Order and customer keys: pixels of images beyond the pole, whose longitudes pass 180 degrees, and pixels whose latitude by control points or a corner record is a tie of the last digit.
BEYOND = [(896397, 76122), (599816, 55377), (766346, 85437)]
TIES = [(978, 14176), (1603, 2080), (128978, 6176), (3603, 8480)]


@pytest.fixture(scope="module")
def located(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("mixed")
    rows = spark.createDataFrame(BEYOND + TIES + [(i, 20 + i) for i in range(9)], "o_orderkey long, o_custkey long").coalesce(1)
    rows.withColumn("o_totalprice", F.lit(1234.5)).write.parquet(f"{folder}/orders.parquet")
    rows.select(F.col("o_custkey").alias("c_custkey")).distinct().coalesce(1).write.parquet(f"{folder}/customer.parquet")
    return mixed.locate_mixed(spark, str(folder)), folder


def test_longitudes_beyond_the_pole_and_ties(located):
    df, folder = located
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{folder}/orders.parquet/*.parquet')")
    want = sorted(con.execute(mixed.ORACLES["locate_mixed"]).fetchall())
    assert sorted(tuple(r) for r in df.collect()) == want
    assert sum(r[2] > 180 for r in want) == len(BEYOND)


def test_models_do_not_pass_the_driver(located):
    """However small Spark takes the table of models for, no join broadcasts it."""
    plan = located[0]._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
