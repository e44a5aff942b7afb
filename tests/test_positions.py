"""Positions drawn from keys: the same doubles as in DuckDB, and so the same shapes for points on an edge."""

import duckdb
import pytest

from quern.operators import registry

# keys whose points lie on an edge of a shape if their hundredths are taken exactly, and beside it in doubles, or the other way round
ON_EDGES = [36292, 77332, 72668, 10, 78572, 16764, 79004]


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame([(k, 0) for k in ON_EDGES], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(n,) for n in range(25)], "n_nationkey int").write.parquet(f"{tmp_path}/nation.parquet")
    return str(tmp_path)


def test_contains_says_the_same_as_sql_on_edges(spark, tables):
    con = duckdb.connect()
    for t in ("customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS FROM '{tables}/{t}.parquet/*.parquet'")
    got = {(r.n_nationkey, r.c_custkey) for r in registry.QUERIES["g4_contains"](spark, tables).collect()}
    assert got == set(con.execute(f"SELECT n_nationkey, c_custkey FROM ({registry.ORACLES['g4_contains']})").fetchall()) and got


def test_positions_are_the_doubles_of_sql(spark):
    con = duckdb.connect()
    lat, lon = registry._LAT.format(k="k"), registry._LON.format(k="k")
    want = con.execute(f"SELECT k, CAST({lat} AS DOUBLE), CAST({lon} AS DOUBLE) FROM (SELECT range AS k FROM range(36000))").fetchall()
    got = registry._points(spark.range(36000).withColumnRenamed("id", "k"), "k", "c").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("km", [0.0, 30.0, 400.0, 9000.0, 20015.2, 30000.0])
def test_a_crowded_cell_is_shared_by_tasks(spark, monkeypatch, km):
    import random

    from pyspark.sql import functions as F

    from quern.functions import great_circle
    from quern.operators import joins

    for name, value in (("CHUNK", 7), ("TASK_PAIRS", 300), ("TASK_ROWS", 200)):
        monkeypatch.setattr(joins, name, value, raising=False)
    r = random.Random(9)
    spot = lambda i: (i, 89.99 - r.random() / 50, r.uniform(-180, 180)) if i % 3 else (i, r.uniform(-90, 90), r.uniform(-180, 180))
    a = [spot(i) for i in range(60)] + [(60, 10.0, 20.0), (61, None, 1.0)]
    b = [spot(i) for i in range(90)] + [(90, 10.0, 20.0), (91, -10.0, -160.0), (92, 10.0, float("nan"))]
    left, right = spark.createDataFrame(a, "i int, x double, y double"), spark.createDataFrame(b, "j int, u double, v double")
    want = left.crossJoin(right).where(great_circle(F.col("x"), F.col("y"), F.col("u"), F.col("v")) <= km).where("x IS NOT NULL AND NOT isnan(v)")
    out = joins.near(left, right, ("x", "y"), ("u", "v"), km)
    assert out.columns == [*left.columns, *right.columns]
    got = out.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((x.i, x.j) for x in got) == sorted((x.i, x.j) for x in want.collect())
    if km >= 30:
        assert len({x.task for x in got if x.x > 89.9 and x.u > 89.9}) > 3
