"""Exact quantiles without a group's values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 1000


def quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str, accuracy: int = ACCURACY) -> DataFrame:
    """keys and the continuous quantile q of value in each group (nulls left out; a group of nulls has none).

    A sketch brackets the rank: its error is at most n / accuracy, so the true order
    statistics lie between its values at q less and more that much. Values below the bracket
    are counted, those inside it grouped by value; only the few distinct values of the
    bracket, about 4 / accuracy of a group, are put in order.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    lo, hi = max(0.0, q - 2 / accuracy), min(1.0, q + 2 / accuracy)
    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx("__v", F.array(F.lit(lo), F.lit(hi)), accuracy).alias("__at"),
        F.min("__v").alias("__least"),
        F.max("__v").alias("__most"),
        (F.count(F.lit(1)) < 4 * accuracy).alias("__few"),  # so few that one place is more than the sketch's error: all are in order
    )
    lower = F.when(F.col("__few") | F.lit(lo <= 0), F.col("__least")).otherwise(F.col("__at")[0])
    upper = F.when(F.col("__few") | F.lit(hi >= 1), F.col("__most")).otherwise(F.col("__at")[1])
    bounds = sketch.select(*keys, lower.alias("__lo"), upper.alias("__hi"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    near = rows.alias("a").join(bounds.alias("b"), same) if keys else rows.alias("a").crossJoin(bounds.alias("b"))  # one row of bounds a group
    inside = F.col("__v").between(F.col("__lo"), F.col("__hi"))
    counted = near.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.when(inside, F.col("__v")).alias("__v"), F.when(F.col("__v") < F.col("__lo"), F.lit(0)).when(inside, F.lit(1)).otherwise(F.lit(2)).alias("__side"))
    counted = counted.groupBy(*keys, "__side", "__v").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys)
    rank = F.lit(q) * (F.sum("__n").over(w) - 1)
    before = F.coalesce(F.sum("__n").over(w.orderBy("__side", "__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumns({"__rank": rank, "__before": before}).where("__side = 1")
    at = lambda r: F.max(F.when((F.col("__before") <= r) & (r < F.col("__before") + F.col("__n")), F.col("__v")))
    share = F.max("__rank") - F.floor(F.max("__rank"))
    out = placed.groupBy(*keys).agg(at(F.floor("__rank")).alias("__a"), at(F.ceil("__rank")).alias("__b"), share.alias("__share"))
    return out.select(*keys, (F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__share")).alias(name))
