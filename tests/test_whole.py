"""Global numbering and reachability against brute force; geometry beside other work of the session."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from quern import functions as Q
from quern.functions import udf
from quern.operators import whole

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows", [0, 1, 3000])
def test_global_row_number_is_the_window(spark, rows):
    r = random.Random(rows)
    # a third of the rows share one value
    data = [(i, r.choice([None, 7, 7, 7, r.randint(0, 50)])) for i in range(rows)]
    df = spark.createDataFrame(data, "i int, v int").repartition(5)
    out = whole.global_row_number(df, [F.col("v").desc_nulls_last(), F.col("i").asc()], "place")
    plan = out._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" not in plan and out.columns == ["i", "v", "place"]
    want = sorted(data, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert [(x.i, x.place) for x in out.orderBy("place").collect()] == [(i, n) for n, (i, _) in enumerate(want, 1)]


def hops(edges, starts):
    found = {s: 0 for s in starts if s is not None}
    front = list(found)
    while front:
        front = list({b for a, b in edges if a in front and b is not None and b not in found})
        depth = max(found.values()) + 1
        found |= dict.fromkeys(front, depth)
    return found


@pytest.mark.parametrize("shape", ["random", "cycle", "chain", "star", "none"])
def test_reach_is_breadth_first(spark, shape):
    r = random.Random(3)
    edges = {
        "random": [(r.randint(0, 60), r.randint(0, 60)) for _ in range(70)] + [(None, 1), (1, None), (5, 5)],
        "cycle": [(i, (i + 1) % 7) for i in range(7)] * 2,
        "chain": [(i, i + 1) for i in range(20)],  # longer than the tables of rounds that are kept apart
        "star": [(0, i) for i in range(1, 400)] + [(i, 0) for i in range(1, 400)],
        "none": [],
    }[shape]
    starts = [0, 0, 3, None] if shape == "random" else [0]
    e = spark.createDataFrame(edges, "a int, b int")
    s = spark.createDataFrame([(x,) for x in starts], "n int")
    got = [(x.n, x.hops) for x in whole.reach(e, s, "a", "b", "n").collect()]
    assert len(got) == len(set(got)) and dict(got) == hops(edges, starts)


def test_reach_within_rounds(spark):
    e, s = spark.createDataFrame([(i, i + 1) for i in range(9)], "a int, b int"), spark.createDataFrame([(0,)], "n int")
    assert sorted(tuple(x) for x in whole.reach(e, s, "a", "b", "n", rounds=2).collect()) == [(0, 0), (1, 1), (2, 2)]


def test_geometry_beside_other_work(spark):
    own = Q.geometry_session(spark)
    flag = "spark.sql.geospatial.enabled"
    before = spark.conf.get(flag)
    points = own.createDataFrame([(1, 1.5, -2.25), (2, None, 1.0), (3, 0.0, -0.0)], "k int, x double, y double").select("k", udf.point_wkb("x", "y").alias("w"))
    frame = points.select("k", F.expr("st_srid(st_setsrid(st_geomfromwkb(w), 4326))").alias("srid"), F.expr("st_asbinary(st_geomfromwkb(w))").alias("wkb"))
    assert spark.range(10).selectExpr("sum(id)").first()[0] == 45  # the first session works on in between
    got = {r.k: (r.srid, None if r.wkb is None else bytes(r.wkb)) for r in frame.collect()}
    assert got[1] == (4326, b"\x01\x01\x00\x00\x00" + struct.pack("<dd", 1.5, -2.25)) and got[2] == (None, None)
    assert spark.conf.get(flag) == before and own.conf.get(flag) == "true"
