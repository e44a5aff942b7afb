"""Helpers that the training-data operators share: scratch tables, folds, samples."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
_SCRATCH: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is spark.checkpoint.dir of the session; only where that is unset (tests in
    local mode) is a temporary folder of this machine used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="quern-"))
    return _OWN_DIR[0]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there.

    The shuffle files behind it go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if not _SCRATCH:
        atexit.register(_sweep)
    _SCRATCH.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_quern_path", None)
        if path:
            _delete(df.sparkSession, path)
            _SCRATCH[:] = [x for x in _SCRATCH if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    for spark, path in _SCRATCH:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone when the interpreter ends
            return


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(n)


def unit_hash(col: Column, seed: int = 7) -> Column:
    """A number in [0, 1) drawn from a value."""
    return F.pmod(F.xxhash64(col, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def labelled_sample(df: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int):
    """At most per_label rows for each label, as pandas (id, label, text).

    One scan counts the labels and one keeps the ids whose hash falls under the
    label's share. Texts are whole. The driver holds labels x per_label rows at most.
    """
    rows = df.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label_col).count().collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for label, n in sorted(counts.items(), key=str):
        share = F.when(F.col(label_col) == F.lit(label), F.lit(1.15 * per_label / n)).otherwise(share)
    draw = unit_hash(F.col(id_col))
    got = (
        rows.where(draw < share)
        .select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text"), draw.alias("draw"))
        .limit(3 * per_label * max(1, len(counts)))
        .toPandas()
        .sort_values(["label", "draw", "id", "text"], kind="stable")
    )
    return got.groupby("label", sort=True).head(per_label)[["id", "label", "text"]].reset_index(drop=True)
