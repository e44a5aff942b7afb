"""Sessions closed by event-time timers: equal to the batch answer, and their state goes."""

import datetime

import pytest
from pyspark.sql import functions as F

from quern import streaming as S

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("gap", [1800, 40_000])
def test_timed_sessions_are_the_batch_sessions(spark, tmp_path, gap):
    import os

    e = spark.read.parquet(f"{SF}/events.parquet")
    times = e.select("ts").orderBy("ts").toPandas()["ts"]
    folder = tmp_path / "events.parquet"
    os.mkdir(folder)
    table = e.orderBy("ts").toPandas()
    cuts = [0, 300, 550, 551, 800, len(table)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        table.iloc[a:b].sample(frac=1, random_state=k).astype({"ts": "datetime64[us]"}).to_parquet(folder / f"p{k}.parquet", index=False)
        os.utime(folder / f"p{k}.parquet", (1_700_000_000 + 100 * k,) * 2)
    progress = []
    got = S.drain(S.timed_sessions(S.events(spark, str(tmp_path), 1), gap), progress=progress).collect()
    rows = e.withColumn("ts", F.col("ts").cast("timestamp"))
    w = F.session_window("ts", f"{gap} seconds")
    batch = rows.groupBy("user_id", w).agg(F.count(F.lit(1)).alias("n"))
    mark = times.iloc[-1].to_pydatetime() - datetime.timedelta(hours=1)
    mark = mark.replace(microsecond=mark.microsecond // 1000 * 1000)
    want = [(r.user_id, r.session_window.start, r.n) for r in batch.collect() if r.session_window.end.replace(tzinfo=None) <= mark]
    assert sorted((r.user_id, r.start, r.n) for r in got) == sorted(want) and len(want) > 20
    # what is open in the end is all that is held: states of closed sessions and their timers are gone
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert held[-1] < max(held)


def test_a_batch_reads_and_writes_the_state_of_a_key_once():
    """However many sessions a key holds: every call is a round trip."""
    import pandas as pd

    calls = []

    class State:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            calls.append("clear")
            self.value = None

    class Handle:
        def __getattr__(self, name):  # whatever kind of state is asked for, timers too
            return lambda *a: calls.append(name) or held

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getExpiryTimeInMs(self):
            return self.ms

        getCurrentWatermarkInMs = getExpiryTimeInMs

    held, p = State(), S._Sessions(1_000_000)
    p.init(Handle())
    hours = [3_600_000_000 * h for h in range(1000)]
    frames = [pd.DataFrame({"micros": hours[500:]}), pd.DataFrame({"micros": [*hours[:500], hours[7] + 999_999, hours[7] + 1_999_998, hours[8] + 1_000_000]})]
    assert list(p.handleInputRows((5,), iter(frames), At(0))) == []
    assert len(calls) <= 5
    calls.clear()
    (out,) = p.handleExpiredTimer((5,), At(9 * 3_600_000), At(9 * 3_600_000))
    assert list(zip(out["user_id"], out["micros"], out["n"], strict=True)) == [(5, h, 3 if h == hours[7] else 1) for h in [*hours[:9], hours[8] + 1_000_000][:8]] + [(5, hours[8], 1), (5, hours[8] + 1_000_000, 1)]
    assert len(calls) <= 4
    (out,) = p.handleExpiredTimer((5,), At(hours[-1]), At(hours[-1]))
    assert len(out) == 991 and held.value is None
