"""Arrow files as source, sink and stream against Spark's own readers."""

import datetime
import os
import random

import pyarrow as pa
import pyarrow.fs as fs
import pytest
from pyspark.sql import functions as F

from quern import sources
from quern.sources.arrow_files import read_arrow, stream_arrow, write_arrow
from quern.streaming import drain

SF = "/root/testdata/sf0.001"
PUSH = "spark.sql.python.filterPushdown.enabled"


@pytest.fixture
def pushing(spark):
    before = spark.conf.get(PUSH)
    spark.conf.set(PUSH, "true")
    yield spark
    spark.conf.set(PUSH, before)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("uri", [False, True])
def test_orders_come_back_in_slices(spark, tmp_path, uri):
    at = f"file:{tmp_path}/o" if uri else str(tmp_path / "o")
    orders = sources.table(spark, SF, "orders").repartition(3)
    write_arrow(orders, at)
    assert all(n.startswith("part-") for n in os.listdir(tmp_path / "o"))
    back = read_arrow(spark, at, slice_bytes=5000)
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in orders.schema]
    assert back.rdd.getNumPartitions() > 3 and rows(back) == rows(orders)
    assert read_arrow(spark, at, orders.select("o_totalprice", "o_orderkey").schema).columns == ["o_totalprice", "o_orderkey"]
    assert read_arrow(spark, at).select(F.lit(1)).count() == orders.count()


def test_a_stated_schema_is_all_that_is_read(spark, tmp_path):
    orders = sources.table(spark, SF, "orders")
    write_arrow(orders, str(tmp_path))
    some = orders.select("o_orderdate", "o_orderkey")
    assert rows(read_arrow(spark, str(tmp_path), some.schema)) == rows(some)
    wider = read_arrow(spark, str(tmp_path), spark.createDataFrame([], "o_orderkey decimal(20,0)").schema)
    assert sorted(int(r[0]) for r in wider.collect()) == sorted(r[0] for r in orders.select("o_orderkey").collect())
    with pytest.raises(Exception, match="no column missing"):
        read_arrow(spark, str(tmp_path), spark.createDataFrame([], "missing int").schema).collect()


FILTERS = [
    "i = 3", "i <> 3", "i > 2 AND i <= 7", "i < 4 AND NOT i = 1", "i IN (1, 4, 9)", "i NOT IN (1, 4)", "i IN (1, null)", "i NOT IN (1, null)", "i IS NULL", "i IS NOT NULL", "i <=> null", "i <=> 3",
    "s = 'b'", "s >= 'b'", "s LIKE 'a%'", "s LIKE '%é'", "s LIKE '%x%'", "NOT s LIKE 'a%'", "s = ''", "d > DATE '2020-01-03'", "b", "NOT b", "f = double('NaN')", "f > 1", "f <= 1", "t < TIMESTAMP_NTZ '2020-01-01 02:00:00'",
    "i = 3 OR s = 'b'", "i = 3 AND (s = 'b' OR f > 1)", "length(s) = 1 AND i > 1", "i > 10000000000", "m.x = 2", "`a.b` = 1",
]


def test_filters_mean_the_same_in_the_source(pushing, tmp_path):
    r = random.Random(6)
    day = datetime.date(2020, 1, 1)
    data = [
        (r.choice([None, *range(10)]), r.choice([None, "", "a", "ax", "b", "Bé", "xé"]), r.choice([None, day, day + datetime.timedelta(r.randint(0, 5))]), r.choice([None, True, False]),
         r.choice([None, float("nan"), -0.0, 0.5, 1.0, 2.0, float("inf")]), datetime.datetime(2020, 1, 1, r.randint(0, 5)), (r.choice([None, 2, 3]),), r.choice([None, 1, 2]))
        for _ in range(300)
    ]
    df = pushing.createDataFrame(data, "i int, s string, d date, b boolean, f double, t timestamp_ntz, m struct<x int>, `a.b` int").repartition(3)
    write_arrow(df, str(tmp_path))
    for f in FILTERS:
        assert rows(read_arrow(pushing, str(tmp_path)).where(f)) == rows(df.where(f)), f
    plan = lambda f: read_arrow(pushing, str(tmp_path)).where(f)._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan("f > 1").replace("PushedFilters", "").replace("Filters:", "")  # a NaN is Spark's
    assert "EqualTo(i,3)" in read_arrow(pushing, str(tmp_path)).where("i = 3")._jdf.queryExecution().explainString(pushing._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_stay_with_spark_where_they_are_off(spark, tmp_path):
    df = spark.range(50).selectExpr("int(id) AS i")
    write_arrow(df, str(tmp_path))
    before = spark.conf.get(PUSH)
    spark.conf.set(PUSH, "false")
    try:
        assert read_arrow(spark, str(tmp_path)).where("i > 40").count() == 9
    finally:
        spark.conf.set(PUSH, before)


def test_no_rows_keep_their_schema_and_overwriting_is_refused(spark, tmp_path):
    none = spark.createDataFrame([], "i int, t timestamp_ntz")
    write_arrow(none, str(tmp_path / "none"))
    back = read_arrow(spark, str(tmp_path / "none"))
    assert back.count() == 0 and back.schema == none.schema
    with pytest.raises(Exception, match="not overwritten"):
        none.write.format("arrow_files").mode("overwrite").save(str(tmp_path / "none"))
    with pytest.raises(Exception, match="no Arrow file"):
        read_arrow(spark, str(tmp_path / "absent")).count()
    assert read_arrow(spark, str(tmp_path / "absent"), none.schema).count() == 0


def test_a_failed_write_leaves_nothing_to_read(spark, tmp_path):
    at = str(tmp_path / "x")
    write_arrow(spark.range(10), at)
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        write_arrow(bad, at)
    assert read_arrow(spark, at).count() == 10


def test_files_of_others_are_cast_or_refused(spark, tmp_path):
    batch = pa.record_batch({"i": pa.array([1, None, 3], pa.int32()), "s": pa.array(["a", "b", None], pa.large_string())})
    with fs.LocalFileSystem().open_output_stream(str(tmp_path / "a.arrow")) as sink, pa.ipc.new_file(sink, batch.schema) as out:
        for _ in range(5):
            out.write_batch(batch)
    df = read_arrow(spark, str(tmp_path), spark.createDataFrame([], "s string, i long").schema, slice_bytes=100)
    assert rows(df) == rows(spark.createDataFrame([("a", 1), ("b", None), (None, 3)] * 5, "s string, i long"))


def test_a_stream_goes_on_behind_its_last_file(spark, tmp_path):
    e = sources.table(spark, SF, "events").select("event_id", "user_id", "ts")
    at, run = str(tmp_path / "e"), str(tmp_path / "run")
    stream = lambda: stream_arrow(spark, at, e.schema, slice_bytes=2000)
    write_arrow(e.where("event_id < 300").repartition(3), at)
    seen = []
    for low in (300, 600, None):
        out = drain(stream(), at=run, progress=seen)
        assert rows(out) == rows(e.where(f"event_id < {low}") if low else e)
        if low == 300:
            write_arrow(e.where("event_id >= 300 AND event_id < 600"), at)
        elif low == 600:
            write_arrow(e.where("event_id >= 600"), at)
    assert sum(p.numInputRows for p in seen) == e.count()  # no file is read twice
    before = out.count()
    assert drain(stream(), at=run).count() == before  # nothing new
