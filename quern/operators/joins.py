"""Joins that Spark has no physical strategy of its own for."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans import written


def _position(df: DataFrame, c: str) -> Column:
    """A time in seconds, or a number, as a double."""
    of = df.schema[c].dataType.simpleString()
    return (F.col(c).cast("timestamp") if of in ("timestamp_ntz", "date") else F.col(c)).cast("double")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, value: str, row: str, tie: str, span: float) -> DataFrame:
    """Each left row with the value of the latest right row at or before it (null if there is none).

    Rows of both sides are merged by key and bin of time (`span` seconds, or units of a
    number), and the last right value is carried forward in a window over the bin. What
    precedes a bin comes from a window over the latest right row of each bin, one row a
    bin however many rows a key has: a key with most of the rows spreads over its bins.
    row identifies a left row; ties of right times go to the larger `tie`. Null keys and
    null times match nothing.
    """
    from pyspark.sql import Window

    mark = F.struct(F.col(right_at).alias("at"), F.col(tie).alias("tie"), F.col(value).alias("value"))
    bin_of = lambda df, c: F.floor(_position(df, c) / F.lit(float(span))).cast("long").alias("__bin")
    r = right.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, right_at]))
    r = r.select(*keys, bin_of(right, right_at), F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(left.schema[row].dataType).alias(row), mark.alias("__mark"))
    l = left.select(*keys, bin_of(left, at), F.col(at).alias("__at"), F.lit(1).alias("__side"), F.col(row), F.lit(None).cast(r.schema["__mark"].dataType).alias("__mark"))
    both = r.unionByName(l)
    inside = Window.partitionBy(*keys, "__bin").orderBy("__at", "__side", "__mark").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("__last", F.last("__mark", ignorenulls=True).over(inside)).where("__side = 1")
    before = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = both.groupBy(*keys, "__bin").agg(F.max("__mark").alias("__best"), F.max("__side").alias("__side"))
    bins = bins.withColumn("__carried", F.last("__best", ignorenulls=True).over(before)).where("__side = 1 AND __carried IS NOT NULL")
    got = got.join(bins.select(*keys, "__bin", "__carried"), [*keys, "__bin"], "left")
    return got.select(*keys, F.col("__at").alias(at), row, F.coalesce("__last", "__carried")["value"].alias(value))


def band(left: DataFrame, right: DataFrame, left_at: str, right_at: str, width: float, condition: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with right_at in [left_at, left_at + width], equal keys if there are any, and the exact condition, without a nested loop.

    Positions are cut into bins of the band's width. A right row is in its bin only, a
    left row in all from its own to that of its upper end (two, seldom three), so no pair
    appears twice, and a key with most of the rows spreads over its bins. The upper end is
    taken with what rounding may add to a sum of doubles, or of integers beyond 2^53.
    """
    if not width > 0:
        raise ValueError("the width of a band must be positive")
    bin_of = lambda x: F.floor(x / F.lit(float(width))).cast("long")
    at = F.col(left_at).cast("double")
    end = at + F.lit(float(width))
    l = left.withColumn("__bin", F.explode(F.sequence(bin_of(at), bin_of(end + F.abs(end) * F.lit(2.0**-51)))))
    r = right.withColumn("__bin", bin_of(F.col(right_at).cast("double")))
    return l.join(r, [*keys, "__bin"]).where(condition).drop("__bin")


EARTH_KM = 6371.0088
CHUNK = 2_000  # right rows of a cell that are met at once
TASK_PAIRS, TASK_ROWS = 50_000_000, 500_000  # what a task of a join by cells compares and holds, about


def _spread(l: DataFrame, r: DataFrame, left_columns: list[str], right_columns: list[str], task_pairs: float) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by __b and __c with a third key, __s, dealt out so that tasks have equal work and grow in number with it.

    The right rows of a crowded cell go to chunks by a hash of their columns, its left rows to lots by theirs, and each chunk meets
    each lot. Partitions follow from the counted pairs: by the size of its rows alone a join whose output is far larger gets too few tasks.
    """
    sides = (df.select("__b", "__c", F.lit(m).alias("__m"), F.lit(n).alias("__n")) for df, m, n in ((l, 1, 0), (r, 0, 1)))
    both = reduce(DataFrame.unionAll, sides).groupBy("__b", "__c").agg(F.sum("__m").alias("__m"), F.sum("__n").alias("__n"))
    # rows that meet nothing are held, too; a lot and a chunk are a quarter of a task's pairs, a lot a quarter of its rows, at most
    lots = F.greatest(F.col("__m") * F.least(F.col("__n"), F.lit(CHUNK)) / task_pairs, F.col("__m") / TASK_ROWS) * 4
    cells = written(both.withColumns({"__i": F.greatest(F.ceil(lots), F.lit(1)), "__k": F.greatest(F.ceil(F.col("__n") / CHUNK), F.lit(1))}))
    pairs, rows = cells.agg(F.sum(F.col("__m").cast("double") * F.col("__n")), F.sum(F.col("__m") * F.col("__k") + F.col("__n") * F.col("__i"))).first()
    tasks = math.ceil(max((pairs or 0) / task_pairs, (rows or 0) / TASK_ROWS, 1))
    crowded = F.broadcast(cells.where("__i > 1 OR __k > 1").select("__b", "__c", "__i", "__k"))  # a row for CHUNK rows or a quarter of a task
    i, k = (F.coalesce(c, F.lit(1).cast("long")) for c in ("__i", "__k"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    l = l.join(crowded, ["__b", "__c"], "left").withColumn("__s", each(k)).withColumn("__s", F.col("__s") * i + F.pmod(F.xxhash64(*left_columns), i))
    r = r.join(crowded, ["__b", "__c"], "left").withColumn("__s", each(i)).withColumn("__s", F.col("__s") + F.pmod(F.xxhash64(*right_columns), k) * i)
    return tuple(df.drop("__i", "__k").repartition(tasks, "__b", "__c", "__s") for df in (l, r))


def near(left: DataFrame, right: DataFrame, left_at: tuple[str, str], right_at: tuple[str, str], km: float, task_pairs: float | None = None) -> DataFrame:
    """Pairs of points (latitude, longitude in degrees) at most `km` apart on the sphere, by cells instead of a nested loop.

    The sphere is cut into bands of latitude as wide as the distance, a band into cells at
    least that wide. A right point is in its cell; a left point is in all cells that the
    distance can reach, in its own band and the two beside it, across the date line and
    around the poles. Null and non-finite positions are near nothing. Pairs are first compared by their chord, and only those within rounding of
    the distance by the formula. Pairs of cells are counted beforehand, so that tasks grow in number with them (`_spread`):
    `task_pairs` are compared in one, fewer where the caller sorts what comes out.
    """
    from quern.functions import great_circle

    if not km >= 0:
        raise ValueError("a distance cannot be negative")
    deg = max(math.degrees(km / EARTH_KM), 1e-6)  # cells of a decimetre at least
    bands = max(1, math.floor(180 / deg))
    tall = 180 / bands
    ok = lambda lat, lon: F.col(lat).between(-90, 90) & F.col(lon).between(-360, 360)
    band_of = lambda lat: F.least(F.floor((F.col(lat) + 90) / F.lit(tall)), F.lit(bands - 1)).cast("long")
    # the widest circle of a band is its edge nearer to the equator; there its cells are as wide as the distance
    edge = lambda b: F.least(F.abs(b * F.lit(tall) - 90), F.abs((b + 1) * F.lit(tall) - 90))
    cells = lambda b: F.greatest(F.floor(360 * F.cos(F.radians(edge(b))) / F.lit(deg)), F.lit(1)).cast("long")
    cell = lambda lon, b: F.floor((lon + 180) / 360 * cells(b)).cast("long")
    lat, lon = left_at
    reach = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(math.radians(min(deg, 90)))) / F.cos(F.radians(lat)))))
    reach = F.when(F.abs(lat) + F.lit(deg) >= 89.999, F.lit(180.0)).otherwise(reach * 1.000001)
    l = left.where(ok(*left_at)).withColumn("__b", F.explode(F.filter(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: band_of(lat) + o), lambda b: (b >= 0) & (b < bands))))
    l = l.withColumn("__c", F.explode(F.array_distinct(F.transform(F.sequence(cell(F.col(lon) - reach, F.col("__b")), cell(F.col(lon) + reach, F.col("__b"))), lambda c: F.pmod(c, cells(F.col("__b")))))))
    r = right.where(ok(*right_at)).withColumn("__b", band_of(right_at[0])).withColumn("__c", F.pmod(cell(F.col(right_at[1]), F.col("__b")), cells(F.col("__b"))))
    far = great_circle(F.col(lat), F.col(lon), F.col(right_at[0]), F.col(right_at[1]))
    hashed = ([c for c, kind in df.dtypes if not any(x in kind for x in ("map<", "variant", "geo"))] for df in (left, right))
    l, r = _spread(l.withColumns(_on_sphere("__l", lat, lon)), r.withColumns(_on_sphere("__r", *right_at)), *hashed, task_pairs or TASK_PAIRS)
    steps = [F.col(f"__l{c}") - F.col(f"__r{c}") for c in "xyz"]
    chord = sum((d * d for d in steps[1:]), steps[0] * steps[0])
    most = 4 * math.sin(min(km / EARTH_KM, math.pi) / 2) ** 2
    slack = 1e-12 * math.sqrt(most) + 1e-24  # far more than rounding adds
    within = F.when(chord > F.lit(most + slack), False).when(chord < F.lit(most - slack), True).otherwise(far <= F.lit(km))
    return l.join(r, ["__b", "__c", "__s"]).where(within).drop("__b", "__c", "__s", *(f"__{side}{c}" for side in "lr" for c in "xyz"))


def _on_sphere(name: str, lat: str, lon: str) -> dict[str, Column]:
    up, along = F.radians(F.col(lat).cast("double")), F.radians(F.col(lon).cast("double"))
    return {f"{name}x": F.cos(up) * F.cos(along), f"{name}y": F.cos(up) * F.sin(along), f"{name}z": F.sin(up)}
