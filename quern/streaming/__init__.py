"""Structured Streaming operators over the events table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from quern import sources
from quern.plans import scratch

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(spark: SparkSession, sf_dir: str, files_per_batch: int = 100) -> DataFrame:
    """The events table as a stream, with a zoned event time (watermarks need one)."""
    path = f"{sf_dir}/events.parquet"
    e = sources.stream(spark, path, spark.read.parquet(path).schema, files_per_batch)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(df: DataFrame, put, mode: str, at: str, progress: list | None) -> None:
    """Each batch of what is there now through `put`, with state in RocksDB."""
    spark = df.sparkSession
    store = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        q = df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, store)
    q.awaitTermination()
    if progress is not None:
        progress += q.recentProgress


def drain(df: DataFrame, mode: str = "append", at: str | None = None, keys: tuple[str, ...] = (), progress: list | None = None) -> DataFrame:
    """Run a stream over what is there now and return its result.

    Each batch is a Parquet folder of its own number, so a batch that runs again after a
    failure replaces itself and nothing passes through the driver. In append mode the result is what all
    batches put out, in complete mode the last one, in update mode the latest row of each of `keys`. State is kept in RocksDB. With `at`, the folder of an
    earlier run, that run is carried on and the rows of both are returned. `progress` gets what the run reports of its batches.
    """
    if (mode == "update") != bool(keys):
        raise ValueError("update mode, and no other, needs the keys whose latest row counts")
    spark, at = df.sparkSession, at or scratch(df.sparkSession)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/__batch={0 if mode == 'complete' else number}")

    _run(df, put, mode, at, progress)
    out = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/out")
    if not out.getFileSystem(spark._jsc.hadoopConfiguration()).exists(out):
        return spark.createDataFrame([], df.schema)
    rows = spark.read.schema(StructType([*df.schema.fields, StructField("__batch", LongType())])).parquet(f"{at}/out")
    if mode != "update":
        return rows.drop("__batch")
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), "__batch").alias("__row"))
    return latest.select(F.inline(F.array("__row")))


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of a folder's tables (name=number) that are written whole, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(path(folder))] if fs.exists(path(folder)) else []
    return sorted(int(p.getName().partition("=")[2]) for p in found if "=" in p.getName() and fs.exists(path(p, "_SUCCESS")))


def upsert(df: DataFrame, keys: tuple[str, ...], at: str, fold: int = 16, progress: list | None = None) -> DataFrame:
    """Run a stream in update mode over what is there now; the latest row of each key of all runs over the folder `at`.

    A batch, which holds a key once, is a table of its number. Every `fold`th batch writes the latest rows so far as
    one table, from the one before and the batches since; what that one was made of then goes. So
    a reading takes one such table and fewer than `fold` batches however long the stream has run, and a reader that
    began before a fold still finds its files. A batch that runs again replaces itself and its fold;
    tables that are not whole do not count. Null keys are a key.
    """
    if fold < 1 or not keys:
        raise ValueError("an upsert needs keys, and a fold of a batch at least")
    spark, schema = df.sparkSession, df.schema
    path = spark._jvm.org.apache.hadoop.fs.Path

    def latest(own: SparkSession, base: int, upto: int | None = None) -> DataFrame:
        parts = [own.read.schema(schema).parquet(f"{at}/folded/upto={base}").withColumn("__batch", F.lit(base).cast("long"))] if base >= 0 else []
        new = [n for n in _numbers(spark, f"{at}/batches") if n > base and (upto is None or n <= upto)]
        if new:
            numbered = StructType([*schema.fields, StructField("__batch", LongType())])
            parts.append(own.read.schema(numbered).option("basePath", f"{at}/batches").parquet(*(f"{at}/batches/__batch={n}" for n in new)))
        if not parts:
            return own.createDataFrame([], schema)
        rows = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*schema.names), "__batch").alias("__row")).select(F.inline(F.array("__row")))

    def put(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{at}/batches/__batch={number}")
        if number % fold != fold - 1:
            return
        folded = [n for n in _numbers(spark, f"{at}/folded") if n < number]
        base = folded[-1] if folded else -1
        latest(own, base, number).write.mode("overwrite").parquet(f"{at}/folded/upto={number}")
        fs = path(at).getFileSystem(spark._jsc.hadoopConfiguration())
        for old in [f"batches/__batch={n}" for n in _numbers(spark, f"{at}/batches") if n <= base] + [f"folded/upto={n}" for n in folded[:-1]]:
            fs.delete(path(f"{at}/{old}"), True)

    _run(df, put, "update", at, progress)
    return latest(spark, max(_numbers(spark, f"{at}/folded"), default=-1))


def tumbling(e: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    w = F.window("ts", width)
    return e.withWatermark("ts", late).groupBy(w).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(e: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    s = F.session_window("ts", gap)
    return e.withWatermark("ts", late).groupBy("user_id", s).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def first_seen(e: DataFrame, late: str = "60 days") -> DataFrame:
    """The first event of each user within the watermark."""
    return e.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id"])


def views_before_clicks(e: DataFrame, within: str = "30 minutes") -> DataFrame:
    """Pairs of a view and a click of one user; both sides' state is bounded by the watermark."""
    e = e.withWatermark("ts", "1 hour")
    v = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    c = e.where("event_type = 'click'").select(F.col("user_id").alias("click_user"), F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    near = F.expr(f"user_id = click_user AND click_ts >= view_ts AND click_ts <= view_ts + INTERVAL {within}")
    return v.join(c, near).select("view_id", "click_id")


def totals(e: DataFrame) -> DataFrame:
    """Count and sum of each user so far, kept as custom state."""

    def step(key, frames, state):
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [round(total, 2)]})

    return e.select("user_id", "value").groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


class _Totals(StatefulProcessor):
    """Count and sum of a key in one value state."""

    def init(self, handle) -> None:
        self._sum = handle.getValueState("sum", "n long, total double")

    def handleInputRows(self, key, rows, timerValues):
        n, total = self._sum.get() if self._sum.exists() else (0, 0.0)
        for f in rows:
            n, total = n + len(f), total + float(f["value"].sum())
        self._sum.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [round(total, 2)]})

    def close(self) -> None:
        pass


def totals_processor(e: DataFrame) -> DataFrame:
    """As totals, with a stateful processor."""
    return e.select("user_id", "value").groupBy("user_id").transformWithStateInPandas(_Totals(), "user_id long, n long, total double", "update", "None")


class _Sessions(StatefulProcessor):
    """Open sessions of a key in one value (rows of start, last event and count, and when its timer stands); a key's one timer stands at the earliest end, and the state of closed sessions goes.

    A batch reads and writes a key's state once, however many sessions it holds: each call to the state is a round trip to the JVM.
    """

    def __init__(self, gap: int):
        self._gap = gap  # microseconds

    def init(self, handle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", "due long, sessions binary")

    def _held(self) -> tuple[int | None, np.ndarray]:
        got = self._open.get()
        return (None, np.empty((0, 3), "int64")) if got is None else (got[0], np.frombuffer(got[1], "int64").reshape(-1, 3))

    def _due(self, last: np.ndarray) -> np.ndarray:
        """Milliseconds at which a session is over."""
        return -(-(last + self._gap) // 1000)

    def _merged(self, parts: np.ndarray) -> np.ndarray:
        """Sessions, in order, of sessions or events that may overlap."""
        parts = parts[np.argsort(parts[:, 0], kind="stable")]
        last = np.maximum.accumulate(parts[:, 1])
        first = np.flatnonzero(np.concatenate([[True], parts[1:, 0] >= last[:-1] + self._gap]))
        return np.column_stack([parts[first, 0], last[np.append(first[1:], len(parts)) - 1], np.add.reduceat(parts[:, 2], first)])

    def handleInputRows(self, key, rows, timerValues):
        due, held = self._held()
        now = held
        for f in rows:
            at = f["micros"].to_numpy("int64")
            if len(at):
                now = self._merged(np.concatenate([now, np.column_stack([at, at, np.ones_like(at)])]))
        if len(now):
            earliest = int(self._due(now[:, 1]).min())
            if due != earliest:
                if due is not None:
                    self._handle.deleteTimer(due)
                self._handle.registerTimer(earliest)
            if now is not held:
                self._open.update((earliest, now.tobytes()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # all that the watermark has passed, not only the session whose timer this is
        at = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        _, held = self._held()
        due = self._due(held[:, 1])
        over, rest = held[due <= at], held[due > at]
        if len(rest):
            earliest = int(due[due > at].min())
            self._handle.registerTimer(earliest)
            self._open.update((earliest, rest.tobytes()))
        else:
            self._open.clear()
        return iter([pd.DataFrame({"user_id": np.full(len(over), key[0], "int64"), "micros": over[:, 0], "n": over[:, 2]})])

    def close(self) -> None:
        pass


def timed_sessions(e: DataFrame, gap_seconds: int = 1800, late: str = "1 hour") -> DataFrame:
    """user_id, start and n of sessions, each put out once when its timer says that the watermark has passed its end; its state goes then."""
    rows = e.withWatermark("ts", late).select("user_id", "ts", F.unix_micros("ts").alias("micros"))
    out = rows.groupBy("user_id").transformWithStateInPandas(_Sessions(gap_seconds * 1_000_000), "user_id long, micros long, n long", "append", "EventTime")
    return out.select("user_id", F.timestamp_micros("micros").alias("start"), "n")


def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of events of which a tenth arrive late, in a second run over one checkpoint.

    Late rows whose window the first run has closed are behind the watermark and dropped.
    """
    e, at = spark.read.parquet(f"{sf_dir}/events.parquet"), scratch(spark)
    late = F.col("event_id") % 10 == 0
    for part in (e.where(~late), e.where(late)):
        part.write.mode("append").parquet(f"{at}/in")
        s = sources.stream(spark, f"{at}/in", e.schema, 100).withColumn("ts", F.col("ts").cast("timestamp"))
        out = drain(tumbling(s, "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz")), at=at)
    return out


def split_late(e: DataFrame, width: str, late: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Run a stream over what is there now; (rows on time, rows behind the watermark) of all runs over the folder `at`.

    A row is late if its window of `width` ended at or before the watermark that its batch began with: the latest event time
    of all batches before, less `late`. Such rows a windowed count would drop; here they go to a
    sink of their own. Each batch writes its rows and its latest time under its number, so a
    batch that runs again replaces itself; all that passes through the driver is the watermark. Rows without an event time are on time.
    """
    spark = e.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())

    def put(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        mark = None
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/marks")):
            marks = own.read.schema("latest timestamp, __batch long").parquet(f"{at}/marks")
            mark = marks.where(F.col("__batch") < number).agg(F.max("latest") - F.expr(f"INTERVAL {late}")).first()[0]
        behind = F.lit(False) if mark is None else F.coalesce(F.window("ts", width).getField("end") <= F.lit(mark), F.lit(False))
        rows = batch.where("ts IS NULL").withColumn("__late", F.lit(False)).unionByName(batch.where("ts IS NOT NULL").withColumn("__late", behind))
        rows.write.mode("overwrite").parquet(f"{at}/rows/__batch={number}")
        batch.agg(F.max("ts").alias("latest")).write.mode("overwrite").parquet(f"{at}/marks/__batch={number}")

    q = e.writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    kept = StructType([*e.schema.fields, StructField("__late", BooleanType()), StructField("__batch", LongType())])
    some = fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/rows"))
    rows = spark.read.schema(kept).parquet(f"{at}/rows") if some else spark.createDataFrame([], kept)
    return tuple(rows.where(F.col("__late") == flag).drop("__late", "__batch") for flag in (False, True))


def late_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events an hour, on time and late, where a tenth arrives in a second run: together all of the input."""
    e, at = spark.read.parquet(f"{sf_dir}/events.parquet"), scratch(spark)
    late = F.col("event_id") % 10 == 0
    for part in (e.where(~late), e.where(late)):
        part.write.mode("append").parquet(f"{at}/in")
        s = sources.stream(spark, f"{at}/in", e.schema, 100).withColumn("ts", F.col("ts").cast("timestamp"))
        on_time, behind = split_late(s, "1 hour", "1 hour", f"{at}/split")
    both = on_time.withColumn("late", F.lit(0)).unionAll(behind.withColumn("late", F.lit(1)))
    w = F.window("ts", "1 hour")
    counts = both.groupBy(w).agg(F.sum(1 - F.col("late")).alias("on_time"), F.sum("late").alias("late"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "on_time", "late")


def users_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, latest time and sum of each user, from five runs over a fifth of the events each."""
    e, at = spark.read.parquet(f"{sf_dir}/events.parquet"), scratch(spark)
    for k in range(5):
        e.where(F.col("event_id") % 5 == k).write.mode("append").parquet(f"{at}/in")
        s = sources.stream(spark, f"{at}/in", e.schema, 100)
        users = s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"), F.round(F.sum("value"), 2).alias("total"))
        out = upsert(users, ("user_id",), f"{at}/users", fold=2)
    return out
