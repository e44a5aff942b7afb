"""The latest row a key of an update-mode stream, however many batches it had."""

import os

import pytest
from pyspark.sql import functions as F

from quern import sources
from quern import streaming as S

SCHEMA = "k int, v int"


@pytest.mark.parametrize("fold", [1, 3, 16])
def test_latest_row_of_each_key_over_many_batches(spark, tmp_path, fold):
    at = str(tmp_path)
    want, batches = {}, [[(1, 1), (2, 2), (None, 3)], [(1, 5)], [(3, 1), (None, None)], [(2, -9), (2, 1)], [], [(1, 1), (4, 4)], [(4, 1)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")
        totals = sources.stream(spark, f"{at}/in", spark.createDataFrame([], SCHEMA).schema, 1).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
        out = S.upsert(totals, ("k",), f"{at}/out", fold)
        for k, v in rows:
            n, s = want.get(k, (0, None))
            want[k] = (n + 1, s if v is None else (s or 0) + v)
        got = [(r.k, (r.n, r.s)) for r in out.collect()]
        assert len(got) == len(want) and dict(got) == want, i
        # one folded table is read, the one before it may be held by a reader
        names = lambda d: os.listdir(f"{at}/out/{d}") if os.path.exists(f"{at}/out/{d}") else []
        assert len(names("folded")) <= 2 and len(names("batches")) <= 2 * fold
    again = S.upsert(totals, ("k",), f"{at}/out", fold)  # nothing new
    assert {r.k: (r.n, r.s) for r in again.collect()} == want


def test_tables_that_are_not_whole_do_not_count(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([(1, 1)], SCHEMA).write.parquet(f"{at}/in")
    totals = sources.stream(spark, f"{at}/in", spark.createDataFrame([], SCHEMA).schema, 1).groupBy("k").agg(F.sum("v").alias("s"))
    S.upsert(totals, ("k",), f"{at}/out", 2)
    # as a crash leaves them: a fold and a batch without their marks
    spark.createDataFrame([(1, 77)], "k int, s long").write.parquet(f"{at}/out/folded/upto=9")
    spark.createDataFrame([(1, 78)], "k int, s long").write.parquet(f"{at}/out/batches/__batch=8")
    for d in ("folded/upto=9", "batches/__batch=8"):
        os.remove(f"{at}/out/{d}/_SUCCESS")
    assert [tuple(r) for r in S.upsert(totals, ("k",), f"{at}/out", 2).collect()] == [(1, 1)]
    with pytest.raises(ValueError):
        S.upsert(totals, (), f"{at}/out")
    with pytest.raises(ValueError):
        S.upsert(totals, ("k",), f"{at}/out", 0)
