"""Rows behind the watermark: none is lost, and Spark's own count of dropped rows agrees."""

import datetime

from pyspark.sql import functions as F

from quern import sources
from quern import streaming as S

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp"


def test_late_rows_are_kept_and_counted_as_spark_does(spark, tmp_path):
    hours = lambda *h: [T0 + datetime.timedelta(hours=x) for x in h]
    # the watermark is an hour behind: after the first batch 9.5, after the second still 9.5, after the third 14
    batches = [hours(0.5, 1.5, 10.5), hours(0.7, 8.2, 9.2, 9.7, 1.1, 1.2), hours(15.0, 8.9, 9.1), [*hours(13.5, 14.5, 2.5), None]]
    at, n, progress = str(tmp_path), 0, []
    want = {"late": [], "on time": []}
    mark = None
    for times in batches:
        rows = [(n + i, t) for i, t in enumerate(times)]
        n += len(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = sources.stream(spark, f"{at}/in", spark.createDataFrame([], SCHEMA).schema, 100)
        on_time, late = S.split_late(stream, "1 hour", "1 hour", f"{at}/split")
        S.drain(S.tumbling(stream.coalesce(1), "1 hour"), at=f"{at}/counts", progress=progress)
        for i, t in rows:
            end = None if t is None else t.replace(minute=0) + datetime.timedelta(hours=1)
            want["late" if mark is not None and end is not None and end <= mark else "on time"].append(i)
        newest = max(t for t in times if t is not None) - datetime.timedelta(hours=1)
        mark = newest if mark is None else max(mark, newest)
    assert sorted(r.event_id for r in late.collect()) == sorted(want["late"]) and want["late"]
    assert sorted(r.event_id for r in on_time.collect()) == sorted(want["on time"])
    # Spark counts what it drops behind the partial sums: a row for each late window of a batch
    dropped = sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"])
    late_windows = {(sum(i >= sum(map(len, batches[: k + 1])) for k in range(len(batches))), [t for b in batches for t in b][i].hour) for i in want["late"]}
    assert dropped == len(late_windows)


def test_no_batches(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = sources.stream(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema, 1)
    on_time, late = S.split_late(stream, "1 hour", "1 hour", f"{tmp_path}/split")
    assert on_time.count() == late.count() == 0 and on_time.columns == ["event_id", "ts"]
    assert on_time.agg(F.max("ts")).first()[0] is None
