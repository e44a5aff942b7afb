"""Session settings and table access."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", **conf) -> SparkSession:
    """A session in UTC with adaptive execution; conf overrides, with __ for the dots of a key."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("quern")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(cores if cores != "*" else 8),
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


_FOLDERS: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession) -> str:
    """A new folder's name in the shared folder of the session, in a temporary one where that is unset; it goes when Python ends."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="quern-")
    if not _FOLDERS:
        atexit.register(_sweep)
    _FOLDERS.append((spark, f"{named}/quern_{uuid.uuid4().hex}"))
    return _FOLDERS[-1][1]


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in a scratch folder, read again: its lineage ends there."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sweep() -> None:
    for spark, path in _FOLDERS:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the JVM may be gone by then
            return
