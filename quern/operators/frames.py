"""Windows whose partition holds most of the rows, or all: cut into bins, so that one key spreads over many tasks.

Where no key is hot, Spark's own windows shuffle less and should be taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.whole import global_row_number

SIZE = 100_000  # rows of a bin where bins are cut by number
_COMBINED = {"sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: F.coalesce(a, F.lit(0)) + b, "min": F.least, "max": F.greatest}


def _copied(df: DataFrame, place: Column, before: int, after: int, width: int, carried: list[str]) -> DataFrame:
    """Each row in its own bin (__home) and in all bins that hold a row whose frame it is in; a copy has only the columns `carried`."""
    bin_of = lambda x: F.floor(x / F.lit(width))  # noqa: E731  never falls as x grows, which is all that the cut needs
    bins = F.sequence(bin_of(place - F.lit(after)), bin_of(place + F.lit(before)))
    out = df.withColumn("__own", bin_of(place)).withColumn("__bin", F.explode(bins)).withColumn("__home", F.col("__bin") == F.col("__own"))
    return out.select("__bin", "__home", *(F.col(c) if c in carried else F.when(F.col("__home"), F.col(c)).alias(c) for c in df.columns))


def _place(df: DataFrame, at: str) -> Column:
    kind = df.schema[at].dataType.simpleString()
    if kind not in ("timestamp", "timestamp_ntz", "date", "bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"{at} is neither a time nor a whole number but {kind}")
    return F.unix_micros(F.col(at).cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col(at).cast("long")


_MERGED = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}  # of aggregates of parts


def range_totals(df: DataFrame, keys: list[str], at: str, before: int, after: int, aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """As `range_frame`, for aggregates that parts add up to: name to (sum, count, min or max; column). However many rows a frame holds, a row costs the same.

    Time is cut into blocks as long as a frame, so a frame is the end of one block and the
    beginning of the next. Each block runs once forwards and once backwards, over its values and over the
    ends of frames in it, and the two parts of a frame meet by its keys and place. Equal places are one value,
    combined map-side. Sums of doubles are added in another order than a plain window's, so their last digits may differ.
    """
    if before < 0 or after < 0:
        raise ValueError("a frame reaches back and ahead by no less than 0")
    if wrong := {how for how, _ in aggs.values()} - set(_MERGED):
        raise ValueError(f"no {', '.join(sorted(wrong))} of parts")
    length = before + after
    placed = df.withColumn("__place", _place(df, at))
    names = {name: f"__v{i}" for i, name in enumerate(aggs)}
    # rows without `at` are one place: each other's frame
    values = placed.groupBy(*keys, "__place").agg(*(getattr(F, how)(c).alias(names[name]) for name, (how, c) in aggs.items()))
    if length:
        place, back = F.col("__place"), F.lit(before).cast("long")
        # (order in its run, run, mark); whole numbers throughout, as both parts of a frame must be in blocks side by side
        block = lambda x: F.call_function("div", x - F.pmod(x, F.lit(length).cast("long")), F.lit(length).cast("long"))
        end = lambda backwards, x, mark: F.struct((-x if backwards else x).alias("at"), (2 * block(x) + int(backwards)).alias("block"), F.lit(mark).alias("mark"))
        ends = F.array(end(False, place, False), end(True, place, False), end(True, place - back, True), end(False, place + F.lit(after).cast("long"), True))
        runs = values.where("__place IS NOT NULL").withColumn("__e", F.explode(ends))
        runs = runs.select(*keys, "__place", "__e.*", *(F.when(~F.col("__e.mark"), F.col(v)).alias(v) for v in names.values()))
        # ends stand behind the values of their place
        run = Window.partitionBy("block", *keys).orderBy("at", "mark").rowsBetween(Window.unboundedPreceding, 0)
        merged = {names[name]: _MERGED[how] for name, (how, _) in aggs.items()}
        parts = runs.select(*keys, "__place", "mark", *(f(v).over(run).alias(v) for v, f in merged.items())).where("mark")
        frames = parts.groupBy(*keys, "__place").agg(*(f(v).alias(v) for v, f in merged.items()))
        values = frames.unionByName(values.where("__place IS NULL"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, "__place"]]
    both = placed.alias("a").join(values.alias("b"), same)
    return both.select(*(F.col(f"a.{c}").alias(c) for c in df.columns), *(F.col(f"b.{names[n]}").alias(n) for n in aggs))


def range_frame(df: DataFrame, keys: list[str], at: str, before: int, after: int, aggs: dict[str, Column], reads: list[str], width: int | None = None) -> DataFrame:
    """df with aggregates over the rows of equal keys whose `at` lies in [at - before, at + after].

    Any aggregates; each frame is gone through anew, so a row costs what its frame holds. Where frames
    grow with the table and parts add up, `range_totals` is the one to take.

    `at` is a time, with the frame in microseconds, or a whole number. Rows are binned by it
    (`width`, four frames by default), and a row is copied into the bins beside its own that its
    distance from their edge reaches: five copies of four rows. A task holds a key's rows of a
    bin, not the key's. `reads` names the columns that the aggregates use, all that copies carry.
    No keys mean one frame over the table. Null keys are a key of their own; rows
    without `at` have each other as their frame, as in SQL, and are aggregated beforehand.
    """
    if before < 0 or after < 0 or (width is not None and width < 1):
        raise ValueError("a frame reaches back and ahead by no less than 0, a bin is wider")
    width = width or max(1, 4 * (before + after))
    some = df.where(F.col(at).isNotNull()).withColumn("__place", _place(df, at))
    w = Window.partitionBy(*keys, "__bin").orderBy("__place").rangeBetween(-before, after)
    copied = _copied(some, F.col("__place"), before, after, width, [*keys, *reads, "__place"])
    out = copied.withColumns({name: agg.over(w) for name, agg in aggs.items()}).where("__home").select(*df.columns, *aggs)
    none = df.where(F.col(at).isNull())
    total = none.groupBy(*keys).agg(*(agg.alias(name) for name, agg in aggs.items()))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] or [F.lit(True)]
    none = none.alias("a").join(total.alias("b") if keys else F.broadcast(total.alias("b")), same)  # without keys one row
    return out.unionByName(none.select(*(F.col(f"a.{c}").alias(c) for c in df.columns), *(F.col(f"b.{n}").alias(n) for n in aggs)))


def rows_frame(df: DataFrame, keys: list[str], order: list[Column], before: int, after: int, aggs: dict[str, Column], reads: list[str], size: int = SIZE) -> DataFrame:
    """df with aggregates over the `before` rows before each row of its keys, itself, and the `after` rows behind it.

    Rows are numbered over the whole table by keys and order without a window in one task, and
    binned by number; only rows within reach of a bin's edge are copied into the next. Ties in
    `order` fall as they come, so it should end in a key. Null keys are a key of their own.
    """
    if before < 0 or after < 0 or size < 1:
        raise ValueError("a frame reaches back and ahead by no less than 0, a bin holds a row")
    placed = global_row_number(df, [*(F.col(k).asc_nulls_first() for k in keys), *order], "__place")
    w = Window.partitionBy(*keys, "__bin").orderBy("__place").rowsBetween(-before, after)
    copied = _copied(placed, F.col("__place"), before, after, size, [*keys, *reads, "__place"])
    return copied.withColumns({name: agg.over(w) for name, agg in aggs.items()}).where("__home").select(*df.columns, *aggs)


def offsets(df: DataFrame, keys: list[str], order: list[Column], columns: dict[str, tuple[str, int]], size: int = SIZE) -> DataFrame:
    """df with the values that lie a number of rows before (positive) or behind (negative) each row of its keys: name to (column, rows).

    lag and lead in the bins of `rows_frame`; null where there is no such row.
    """
    if size < 1:
        raise ValueError("a bin holds a row")
    placed = global_row_number(df, [*(F.col(k).asc_nulls_first() for k in keys), *order], "__place")
    back, ahead = max([0, *(n for _, n in columns.values())]), max([0, *(-n for _, n in columns.values())])
    w = Window.partitionBy(*keys, "__bin").orderBy("__place")
    copied = _copied(placed, F.col("__place"), back, ahead, size, [*keys, *(c for c, _ in columns.values()), "__place"])
    return copied.withColumns({name: F.lag(c, n).over(w) for name, (c, n) in columns.items()}).where("__home").select(*df.columns, *columns)


def running(df: DataFrame, keys: list[str], order: list[Column], aggs: dict[str, tuple[str, str]], size: int = SIZE) -> DataFrame:
    """df with running aggregates by keys up to each row: name to (sum, count, min or max; column).

    Rows are numbered and binned as in `rows_frame`. A bin runs by itself; what came before it
    is a window over one row a bin. Nulls are left out, as in SQL. Sums of doubles are added bin by bin, so
    their last digits may differ from a plain window's.
    """
    if wrong := {how for how, _ in aggs.values()} - set(_COMBINED):
        raise ValueError(f"no running {', '.join(sorted(wrong))}")
    placed = global_row_number(df, [*(F.col(k).asc_nulls_first() for k in keys), *order], "__place")
    placed = placed.withColumn("__bin", F.floor(F.col("__place") / F.lit(size)))
    inside = Window.partitionBy(*keys, "__bin").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    of = lambda how, c: getattr(F, how)(F.col(c))
    bins = placed.groupBy(*keys, "__bin").agg(*(of(how, c).alias(f"__{name}") for name, (how, c) in aggs.items()))
    again = lambda how, c: of("sum" if how == "count" else how, c)  # noqa: E731  counts of bins add up
    bins = bins.select(*keys, "__bin", *(again(how, f"__{name}").over(before).alias(f"__{name}") for name, (how, _) in aggs.items()))
    part = placed.withColumns({name: of(how, c).over(inside) for name, (how, c) in aggs.items()})
    same = [F.col("a.__bin") == F.col("b.__bin"), *(F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys)]
    both = part.alias("a").join(bins.alias("b"), same)
    return both.select(*(F.col(f"a.{c}").alias(c) for c in df.columns), *(_COMBINED[how](F.col(f"b.__{name}"), F.col(f"a.{name}")).alias(name) for name, (how, _) in aggs.items()))


def global_ranks(df: DataFrame, by: list[str], order: list[Column], size: int = SIZE) -> DataFrame:
    """df with rank, dense_rank, percent_rank and cume_dist over the whole table, ordered by `order`, sort expressions of the columns `by`.

    Ties are counted map-side first, so that however many rows share a value they are one row
    where values are put in order; values run in bins and meet the rows again by an equi-join. Nulls
    tie with each other and stand where the order puts them.
    """
    values = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    values = running(values.withColumn("__one", F.lit(1)), [], order, {"__upto": ("sum", "__n"), "dense_rank": ("count", "__one")}, size)
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    values = values.crossJoin(F.broadcast(total)).withColumn("rank", F.col("__upto") - F.col("__n") + 1)  # one row
    values = values.select(
        *by, "rank", "dense_rank",
        F.when(F.col("__total") > 1, (F.col("rank") - 1) / (F.col("__total") - 1)).otherwise(F.lit(0.0)).alias("percent_rank"),
        (F.col("__upto") / F.col("__total")).alias("cume_dist"),
    )
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    both = df.alias("a").join(values.alias("b"), same)
    return both.select(*(F.col(f"a.{c}").alias(c) for c in df.columns), *(F.col(f"b.{c}").alias(c) for c in ("rank", "dense_rank", "percent_rank", "cume_dist")))
