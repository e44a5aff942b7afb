"""Column functions that the engine adds to Spark's."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays, in double precision."""
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def weekday(day: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(day) - 1


def trunc(unit: str, ts: Column) -> Column:
    """date_trunc without a time zone."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0088) -> Column:
    """Distance on a sphere by the haversine formula, of positions in degrees."""
    up, along = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(up), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(along), F.lit(2.0))
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


_CARRIED = ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions")


def geometry_session(spark: SparkSession) -> SparkSession:
    """A session of the same application in which Spark's geometry type and st_ functions are on; they are off by default.

    The switch must hold when a frame runs too, so frames of geometries are built and run in this session, and the given one stays as it is.
    """
    own = spark.newSession()
    for key in _CARRIED:
        if (value := spark.conf.get(key, None)) is not None:
            own.conf.set(key, value)
    own.conf.set("spark.sql.geospatial.enabled", "true")
    return own
