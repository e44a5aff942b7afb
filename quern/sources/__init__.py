"""Batch and streaming sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "json", "csv")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder; filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, path: str, fmt: str, schema) -> DataFrame:
    """Files of one format under a stated schema; nothing is inferred."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    r = spark.read.format(fmt).schema(schema)
    return (r.option("header", True) if fmt == "csv" else r).load(path)


def write(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    w = df.write.format(fmt).mode(mode)
    w = w.partitionBy(*partition_by) if partition_by else w
    (w.option("header", True) if fmt == "csv" else w).save(path)


def stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files, or one such file, `files_per_batch` of them in a batch, oldest first."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)
