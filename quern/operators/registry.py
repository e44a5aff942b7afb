"""All queries of the core engine by name, with the SQL that DuckDB runs against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern import functions as Q
from quern.functions import udf
from quern.operators import frames, joins, spatial, whole
from quern.operators.quantiles import quantile
from quern.plans import scratch
from quern.sources import FORMATS, read, table, write

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def both(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    """A query that Spark's own SQL states best; duck_sql where the dialects differ."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {t: table(spark, sf_dir, t) for t in TABLES if t in spark_sql}
        return spark.sql(spark_sql.format(**{t: "{" + t + "}" for t in frames}), **frames)

    QUERIES[name] = run
    ORACLES[name] = (duck_sql or spark_sql).replace("{", "").replace("}", "")


L = lambda c: F.col(c).cast("long")
R2 = lambda c: F.round(c, 2)

# ------------------------------------------------------------ A. scan, filter, projection


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def a1_scan(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount >= 0.05 AND l_shipdate >= TIMESTAMP '1997-01-01'")
def a2_filter(t):
    keep = F.col("l_quantity").between(10, 20) & (F.col("l_discount") >= 0.05) & (F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    return t("lineitem").where(keep).select("l_orderkey", "l_extendedprice")


@query("SELECT l_orderkey AS k, CAST(floor(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS cents FROM lineitem")
def a3_project(t):
    return t("lineitem").select(F.col("l_orderkey").alias("k"), F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long").alias("cents"))


def a4_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written in every format and read back under the stated schema."""
    orders, at = table(spark, sf_dir, "orders"), scratch(spark)
    out = None
    for fmt in FORMATS:
        write(orders, f"{at}/{fmt}", fmt)
        back = read(spark, f"{at}/{fmt}", fmt, orders.schema).select(F.lit(fmt).alias("fmt"), "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
        out = back if out is None else out.unionAll(back)
    return out


QUERIES["a4_sinks"] = a4_sinks
ORACLES["a4_sinks"] = f"SELECT fmt, o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders, (SELECT unnest({list(FORMATS)}) AS fmt)"

# ------------------------------------------------------------ B. joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def b1_inner_join(t):
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def b2_left_join(t):
    return t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left")


@query("SELECT o_orderkey, l_linenumber FROM (SELECT * FROM orders WHERE o_totalprice > 100000) FULL JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) ON o_orderkey = l_orderkey")
def b3_full_join(t):
    o, l = t("orders").where("o_totalprice > 100000"), t("lineitem").where("l_quantity > 45")
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey"), "full").select("o_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def b4_semi_join(t):
    return t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def b5_anti_join(t):
    return t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def b6_cross_join(t):
    return t("region").crossJoin(t("nation")).select("r_name", "n_name")


@query("SELECT a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 30 MINUTE")
def b7_interval_join(t):
    """Bins of half an hour beside the user, so that a user with most of the events spreads."""
    side = lambda i, s: t("events").select("user_id", F.col("event_id").alias(i), F.unix_micros(F.col("ts").cast("timestamp")).alias(s))
    near = (F.col("u2") > F.col("u1")) & (F.col("u2") <= F.col("u1") + 1_800_000_000)
    return joins.band(side("first_id", "u1"), side("second_id", "u2"), "u1", "u2", 1800e6, near, ("user_id",)).select("first_id", "second_id")


@query("SELECT a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON b.ts > a.ts AND b.ts <= a.ts + INTERVAL 60 SECOND")
def b8_band_join(t):
    side = lambda i, s: t("events").select(F.col("event_id").alias(i), F.unix_micros(F.col("ts").cast("timestamp")).alias(s))
    near = (F.col("u2") > F.col("u1")) & (F.col("u2") <= F.col("u1") + 60_000_000)
    return joins.band(side("first_id", "u1"), side("second_id", "u2"), "u1", "u2", 60e6, near).select("first_id", "second_id")


@query("""SELECT c.event_id, (SELECT max_by(v.event_id, v.ts) FROM events v WHERE v.user_id = c.user_id AND v.event_type = 'view' AND v.ts <= c.ts) AS view_id
FROM events c WHERE c.event_type = 'click'""")
def b9_as_of_join(t):
    e = t("events").select("user_id", "event_id", "ts", "event_type")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"))
    out = joins.as_of(e.where("event_type = 'click'"), views, ["user_id"], "ts", "view_ts", "view_id", "event_id", "view_id", 86400)
    return out.select("event_id", "view_id")


both("b10_not_in_nulls", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 3) FROM {orders})")
both("b10_not_in", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_custkey IS NOT NULL AND o_totalprice > 100000)")
both("b11_scalar_subquery", "SELECT p_partkey FROM {part} p WHERE p_retailprice > (SELECT avg(p2.p_retailprice) FROM {part} p2 WHERE p2.p_brand = p.p_brand)")
both("b12_exists", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
both("b12_not_exists", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)")

# ------------------------------------------------------------ C. aggregation


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 2) AS avg_price, count(*) AS n FROM lineitem GROUP BY ALL")
def c1_group_by(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(R2(F.sum("l_quantity")).alias("sum_qty"), R2(F.avg("l_extendedprice")).alias("avg_price"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL")
def c2_count_distinct(t):
    return t("orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def c3_rollup(t):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def c4_cube(t):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


both("c5_grouping_sets", "SELECT p_brand, p_type, count(*) AS n FROM {part} GROUP BY GROUPING SETS ((p_brand, p_type), (p_brand), ())")


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 2) AS p90 FROM lineitem GROUP BY l_returnflag")
def c6_percentile(t):
    return quantile(t("lineitem"), ["l_returnflag"], "l_extendedprice", 0.9, "p").select("l_returnflag", R2("p").alias("p90"))


@query("SELECT l_returnflag, round(median(l_quantity), 2) AS med FROM lineitem GROUP BY l_returnflag")
def c7_median(t):
    return quantile(t("lineitem"), ["l_returnflag"], "l_quantity", 0.5, "m").select("l_returnflag", R2("m").alias("med"))


both("c8_deviation", "SELECT l_returnflag, round(stddev_samp(l_quantity), 4) AS sd, round(var_pop(l_discount), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r FROM {lineitem} GROUP BY l_returnflag")


_MOMENTS = """(SELECT l_returnflag, avg((l_extendedprice - m) ** 2) AS m2, avg((l_extendedprice - m) ** 3) AS m3, avg((l_extendedprice - m) ** 4) AS m4
FROM (SELECT l_returnflag, l_extendedprice, avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) GROUP BY 1)"""


@query(f"SELECT l_returnflag, round(m3 / power(m2, 1.5), 5) AS skew FROM {_MOMENTS}")
def c9_skewness(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.skewness("l_extendedprice"), 5).alias("skew"))


@query(f"SELECT l_returnflag, round(m4 / power(m2, 2) - 3, 5) AS kurt FROM {_MOMENTS}")
def c9_kurtosis(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.kurtosis("l_extendedprice"), 5).alias("kurt"))


def _off(estimate: str, exact: str, deviation: float):
    """Is the estimate within three standard deviations of the exact number?"""
    return F.abs(F.col(estimate) - F.col(exact)) <= F.lit(3 * deviation) * F.col(exact)


@query("SELECT count(DISTINCT o_orderkey) AS orders, true AS within FROM orders")
def c10_approx_distinct(t):
    d = t("orders").agg(F.approx_count_distinct("o_orderkey", 0.02).alias("a"), F.count_distinct("o_orderkey").alias("orders"))
    return d.select("orders", _off("a", "orders", 0.02).alias("within"))


@query("SELECT count(DISTINCT o_orderkey) AS orders, true AS hll, true AS theta, true AS kll FROM orders")
def c11_sketches(t):
    """HLL and theta of 4096 entries against the exact number, the KLL median (k = 200) by its exact rank."""
    d = t("orders").agg(
        F.expr("hll_sketch_estimate(hll_sketch_agg(o_orderkey, 12))").alias("h"),
        F.expr("theta_sketch_estimate(theta_sketch_agg(o_orderkey, 12))").alias("th"),
        F.expr("kll_sketch_get_quantile_double(kll_sketch_agg_double(o_totalprice, 200), 0.5D)").alias("k"),
        F.count_distinct("o_orderkey").alias("orders"),
    )
    below = t("orders").join(F.broadcast(d.select("k")), F.col("o_totalprice") <= F.col("k"), "left")  # one row
    rank = below.agg((F.count("k") / F.count(F.lit(1))).alias("rank"))
    kll = F.abs(F.col("rank") - 0.5) <= F.lit(3 * 0.0133)
    return d.join(F.broadcast(rank)).select("orders", _off("h", "orders", 1.04 / 64).alias("hll"), _off("th", "orders", 1 / 64).alias("theta"), kll.alias("kll"))


@query("SELECT event_type AS item, count(*) AS n FROM events GROUP BY 1")
def c11_approx_top_k(t):
    """Exact here: the sketch holds far more items than there are types."""
    top = t("events").agg(F.expr("approx_top_k(event_type, 100, 1000)").alias("top"))
    return top.select(F.inline("top")).select("item", F.col("count").alias("n"))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def c11_bitmap_distinct(t):
    """Distinct integers through bitmaps: two map-side combined aggregations, no distinct rows are shuffled."""
    parts = t("orders").groupBy("o_orderpriority", F.bitmap_bucket_number("o_custkey").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("o_custkey")).alias("bits"))
    return parts.groupBy("o_orderpriority").agg(F.sum(F.bitmap_count("bits")).alias("customers"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def c12_ordered_list(t):
    pairs = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return t("nation").groupBy("n_regionkey").agg(F.array_join(F.transform(pairs, lambda x: x["n_name"]), ",").alias("names"))


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1")
def c13_pivot(t):
    p = t("lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return p.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("SELECT l_orderkey, 'l_discount' AS name, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, 'l_tax', l_tax FROM lineitem")
def c14_unpivot(t):
    return t("lineitem").unpivot("l_orderkey", ["l_discount", "l_tax"], "name", "value")


# ------------------------------------------------------------ D. windows, order, sets

_W = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)"
both("d1_ranks", f"SELECT o_orderkey, CAST(row_number() {_W} AS BIGINT) AS rn, CAST(rank() {_W} AS BIGINT) AS rk, CAST(dense_rank() {_W} AS BIGINT) AS dr, CAST(ntile(3) {_W} AS BIGINT) AS nt, round(percent_rank() {_W}, 6) AS pr, round(cume_dist() {_W}, 6) AS cd FROM {{orders}}")
both("d2_offsets", f"SELECT o_orderkey, lag(o_orderkey) {_W} AS prev, lead(o_orderkey, 2) {_W} AS next2, first_value(o_orderkey) {_W} AS top, nth_value(o_orderkey, 2) {_W} AS second FROM {{orders}}")


@query("SELECT o_orderkey, max(o_totalprice) OVER w AS max3, count(*) OVER w AS n3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def d3_rows_frame(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return t("orders").select("o_orderkey", F.max("o_totalprice").over(w).alias("max3"), F.count(F.lit(1)).over(w).alias("n3"))


both("d4_range_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n FROM {events}")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def d5_top_k(t):
    return t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").limit(25)


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def d6_top_k_per_group(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t("orders").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("o_custkey", "o_orderkey")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def d7_union(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def d8_intersect(t):
    return t("customer").select(F.col("c_custkey").alias("k")).intersect(t("orders").select("o_custkey"))


@query("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def d9_except_all(t):
    return t("orders").select(F.col("o_custkey").alias("k")).exceptAll(t("customer").select("c_custkey"))


both("d10_null_order", "SELECT k, CAST(row_number() OVER (ORDER BY k DESC NULLS LAST) AS BIGINT) AS place FROM (SELECT DISTINCT nullif(n_regionkey, 2) AS k FROM {nation})")

_PLACE = "l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY {_PLACE}) AS place FROM lineitem")
def d1_global_row_number(t):
    order = [F.col("l_extendedprice").desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in ("l_orderkey", "l_linenumber", "l_partkey"))]
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return whole.global_row_number(rows, order, "place").drop("l_extendedprice")


@query("""SELECT event_id, count(*) OVER w AS n, max(value) OVER w AS most, min(event_id) OVER w AS least_id FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 30 MINUTE FOLLOWING)""")
def d4_range_frame_hot(t):
    """Partitions as large as a share of the table: there are few event types."""
    aggs = {"n": ("count", "one"), "most": ("max", "value"), "least_id": ("min", "event_id")}
    e = t("events").select("event_id", "event_type", "ts", "value", F.lit(1).alias("one"))
    return frames.range_totals(e, ["event_type"], "ts", 3_600_000_000, 1_800_000_000, aggs).select("event_id", *aggs)


_BY_DAY = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, max(l_extendedprice) OVER w AS most, count(*) OVER w AS n FROM lineitem
WINDOW w AS (PARTITION BY l_returnflag ORDER BY {", ".join(f"{c} NULLS LAST" for c in _BY_DAY)} ROWS BETWEEN 5 PRECEDING AND 2 FOLLOWING)""")
def d3_rows_frame_hot(t):
    """Three return flags share the table."""
    aggs = {"most": F.max("l_extendedprice"), "n": F.count(F.lit(1))}
    rows = t("lineitem").select("l_returnflag", *_BY_DAY)
    out = frames.rows_frame(rows, ["l_returnflag"], [F.col(c).asc_nulls_last() for c in _BY_DAY], 5, 2, aggs, ["l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *aggs)


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, CAST(sum(l_quantity) OVER w AS BIGINT) AS total, count(l_quantity) OVER w AS n, max(l_extendedprice) OVER w AS most FROM lineitem
WINDOW w AS (PARTITION BY l_linestatus ORDER BY {", ".join(f"{c} NULLS LAST" for c in _BY_DAY)} ROWS UNBOUNDED PRECEDING)""")
def d3_running_hot(t):
    """Running totals of two line states."""
    aggs = {"total": ("sum", "l_quantity"), "n": ("count", "l_quantity"), "most": ("max", "l_extendedprice")}
    rows = t("lineitem").select("l_linestatus", "l_quantity", *_BY_DAY)
    out = frames.running(rows, ["l_linestatus"], [F.col(c).asc_nulls_last() for c in _BY_DAY], aggs)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.col("total").cast("long").alias("total"), "n", "most")


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, lag(l_quantity) OVER w AS before, lead(l_quantity, 3) OVER w AS third FROM lineitem
WINDOW w AS (PARTITION BY l_returnflag ORDER BY {", ".join(f"{c} NULLS LAST" for c in (*_BY_DAY, "l_quantity"))})""")
def d2_offsets_hot(t):
    order = (*_BY_DAY, "l_quantity")
    out = frames.offsets(t("lineitem").select("l_returnflag", *order), ["l_returnflag"], [F.col(c).asc_nulls_last() for c in order], {"before": ("l_quantity", 1), "third": ("l_quantity", -3)})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "before", "third")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, rank() OVER w AS place, dense_rank() OVER w AS step, round(percent_rank() OVER w, 6) AS share, round(cume_dist() OVER w, 6) AS upto FROM lineitem
WINDOW w AS (ORDER BY l_quantity DESC NULLS LAST, l_discount NULLS FIRST)""")
def d1_global_ranks(t):
    """Ranks over the whole table by columns of which few values exist."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    out = frames.global_ranks(rows, ["l_quantity", "l_discount"], [F.col("l_quantity").desc_nulls_last(), F.col("l_discount").asc_nulls_first()])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.col("rank").alias("place"), F.col("dense_rank").alias("step"), F.round("percent_rank", 6).alias("share"), F.round("cume_dist", 6).alias("upto"))


# ------------------------------------------------------------ E. scalars and table functions

both(
    "e1_strings",
    "SELECT p_partkey, upper(p_name) AS up, substr(p_name, 2, 3) AS mid, CAST(length(p_name) AS BIGINT) AS len, split_part(p_brand, '#', 2) AS num, reverse(p_type) AS rev, lpad(p_type, 12, '*') AS pad, regexp_replace(p_name, '[aeiou]', '') AS cons FROM {part}",
    "SELECT p_partkey, upper(p_name) AS up, substr(p_name, 2, 3) AS mid, CAST(length(p_name) AS BIGINT) AS len, split_part(p_brand, '#', 2) AS num, reverse(p_type) AS rev, lpad(p_type, 12, '*') AS pad, regexp_replace(p_name, '[aeiou]', '', 'g') AS cons FROM part",
)
both("e2_lengths", "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(octet_length(text) AS BIGINT) AS bytes FROM {documents}", "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
both("e3_md5", "SELECT doc_id, md5(text) AS digest FROM {documents}")
both("e4_dates", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(o_orderdate AS DATE) AS d FROM {orders}")


@query("SELECT o_orderkey, dayofweek(o_orderdate) AS dow FROM orders")
def e5_weekday(t):
    return t("orders").select("o_orderkey", Q.weekday(F.col("o_orderdate")).cast("long").alias("dow"))


@query("SELECT event_id, date_trunc('hour', ts) AS h FROM events")
def e6_date_trunc(t):
    return t("events").select("event_id", Q.trunc("hour", F.col("ts")).alias("h"))


both("e7_math", "SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS unit, l_orderkey % 7 AS m, round(sqrt(l_quantity), 4) AS s FROM {lineitem}")
both("e8_rounding", "SELECT l_orderkey, CAST(floor(l_extendedprice) AS BIGINT) AS lo, CAST(round(l_extendedprice) AS BIGINT) AS near FROM {lineitem}")
both("e9_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")


@query("SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, w AS word FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents)")
def e10_explode(t):
    return t("documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word")).select("doc_id", L("pos").alias("pos"), "word")


@query("SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS d FROM embeddings")
def e11_dot_product(t):
    return t("embeddings").select("vec_id", F.round(Q.dot(F.col("embedding"), F.col("embedding")), 5).alias("d"))


@query("SELECT r_regionkey, r_name AS v FROM region")
def e12_map(t):
    m = t("region").groupBy("r_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("m"))
    return m.select("r_regionkey", F.element_at("m", F.col("r_regionkey")).alias("v"))


# nations as a tree: the children of k are 2k + 1 and 2k + 2
_TREE = "WITH RECURSIVE s(k, depth, top) AS (SELECT n_nationkey, CAST(0 AS BIGINT), n_regionkey FROM {{nation}} WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, depth + 1, top + n.n_regionkey FROM s JOIN {{nation}} n ON (n.n_nationkey - 1) {div} 2 = s.k AND n.n_nationkey > 0) SELECT k, depth, CAST(top AS BIGINT) AS total FROM s"
both("e13_recursive", _TREE.format(div="DIV").replace("{{", "{").replace("}}", "}"), _TREE.format(div="//").replace("{{", "{").replace("}}", "}"))


@query("""WITH RECURSIVE near AS (SELECT a.event_id AS src, b.event_id AS dst FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR),
r(event_id, hops) AS (SELECT event_id, CAST(0 AS BIGINT) FROM events WHERE event_type = 'signup' UNION SELECT dst, hops + 1 FROM r JOIN near ON src = event_id)
SELECT event_id, min(hops) AS hops FROM r GROUP BY 1""")
def e13_reachable(t):
    """Events that follow a signup of their user in steps of an hour at most, and the fewest steps."""
    side = lambda i, s: t("events").select("user_id", F.col("event_id").alias(i), F.unix_micros(F.col("ts").cast("timestamp")).alias(s))
    near = (F.col("u2") > F.col("u1")) & (F.col("u2") <= F.col("u1") + 3_600_000_000)
    steps = joins.band(side("src", "u1"), side("dst", "u2"), "u1", "u2", 3600e6, near, ("user_id",))
    return whole.reach(steps, t("events").where("event_type = 'signup'"), "src", "dst", "event_id")


both("e14_try", "SELECT n_nationkey, try_cast(n_name AS INT) AS bad, round(try_divide(10, n_regionkey), 4) AS q FROM {nation}", "SELECT n_nationkey, try_cast(n_name AS INT) AS bad, round(CASE WHEN n_regionkey <> 0 THEN 10 / n_regionkey END, 4) AS q FROM nation")

# ------------------------------------------------------------ F. time windows


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def f1_tumbling_window(t):
    w = F.window("ts", "1 hour")
    return t("events").groupBy(w).agg(F.count(F.lit(1)).alias("n"), R2(F.sum("value")).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "total")


@query("""SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS s FROM events) GROUP BY 1""")
def f2_sliding_window(t):
    return t("events").groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM
(SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def f3_session_window(t):
    s = F.session_window("ts", "30 minutes")
    return t("events").groupBy("user_id", s).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


# ------------------------------------------------------------ G. positions on the sphere, drawn from keys

_LAT, _LON = "(({k}) * 7919 % 17900) / 100.0 - 89.5", "(({k}) * 104729 % 36000) / 100.0 - 180"
_KM = "2 * 6371.0088 * asin(sqrt(least(1, power(sin(radians({b}_lat - {a}_lat) / 2), 2) + cos(radians({a}_lat)) * cos(radians({b}_lat)) * power(sin(radians({b}_lon - {a}_lon) / 2), 2))))"


def _degrees(key: str) -> tuple[Column, Column]:
    """Latitude and longitude by the steps of the SQL in doubles, as DuckDB divides: what lies on an edge or a radius hangs on the last bit."""
    at = lambda factor, steps, least: (F.col(key) * factor % steps) / F.lit(100.0) - F.lit(least)
    return at(7919, 17900, 89.5), at(104729, 36000, 180.0)


def _points(df: DataFrame, key: str, name: str) -> DataFrame:
    lat, lon = _degrees(key)
    return df.select(key, lat.alias(f"{name}_lat"), lon.alias(f"{name}_lon"))


_POINTS = f"""WITH c AS (SELECT c_custkey, c_nationkey, CAST({_LAT.format(k="c_custkey")} AS DOUBLE) AS c_lat, CAST({_LON.format(k="c_custkey")} AS DOUBLE) AS c_lon FROM customer),
s AS (SELECT s_suppkey, CAST({_LAT.format(k="s_suppkey")} AS DOUBLE) AS s_lat, CAST({_LON.format(k="s_suppkey")} AS DOUBLE) AS s_lon FROM supplier)"""


@query(f"{_POINTS} SELECT c_custkey, round({_KM.format(a='c', b='s')}, 3) AS km FROM c JOIN s ON s_suppkey = c_custkey % 10")
def g2_great_circle(t):
    c = _points(t("customer"), "c_custkey", "c").withColumn("s_suppkey", F.col("c_custkey") % 10)
    both = c.join(_points(t("supplier"), "s_suppkey", "s"), "s_suppkey")
    return both.select("c_custkey", F.round(Q.great_circle(*(F.col(x) for x in ("c_lat", "c_lon", "s_lat", "s_lon"))), 3).alias("km"))


@query(f"{_POINTS} SELECT s_suppkey, c_custkey FROM s, c WHERE {_KM.format(a='s', b='c')} <= 400")
def g3_distance_join(t):
    s, c = _points(t("supplier"), "s_suppkey", "s"), _points(t("customer"), "c_custkey", "c")
    return joins.near(s, c, ("s_lat", "s_lon"), ("c_lat", "c_lon"), 400).select("s_suppkey", "c_custkey")


# the bytes of a double, from its exponent and its fraction
_BITS = "CASE WHEN {v} = 0 THEN 0 ELSE (CASE WHEN {v} < 0 THEN 9223372036854775808 ELSE 0 END)::HUGEINT + (floor(log2(abs({v}))) + 1023)::HUGEINT * 4503599627370496 + ((abs({v}) / pow(2, floor(log2(abs({v}))))  - 1) * 4503599627370496)::HUGEINT END"
_BYTES = lambda h: " || ".join(f"substr({h}, {i}, 2)" for i in range(15, 0, -2))


def g1_wkb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' positions in well-known binary through the geometry type, with a reference system, and back."""
    own = Q.geometry_session(spark)
    points = _points(table(own, sf_dir, "customer"), "c_custkey", "c").select("c_custkey", udf.point_wkb(F.round("c_lon", 2), F.round("c_lat", 2)).alias("w"))
    placed = points.select("c_custkey", F.expr("st_setsrid(st_geomfromwkb(w), 4326)").alias("g"))
    return placed.select("c_custkey", F.expr("CAST(st_srid(g) AS BIGINT)").alias("srid"), F.expr("hex(st_asbinary(g))").alias("wkb"))


QUERIES["g1_wkb"] = g1_wkb
ORACLES["g1_wkb"] = f"""{_POINTS} SELECT c_custkey, CAST(4326 AS BIGINT) AS srid, '0101000000' || {_BYTES("x")} || {_BYTES("y")} AS wkb FROM (
SELECT c_custkey, printf('%016X', ({_BITS.format(v="c_lon")})::UBIGINT) AS x, printf('%016X', ({_BITS.format(v="c_lat")})::UBIGINT) AS y FROM (SELECT c_custkey, round(c_lon, 2) AS c_lon, round(c_lat, 2) AS c_lat FROM c))"""

# ------------------------------------------------------------ G. shapes drawn from keys, in the plane of longitude and latitude

# corners about a centre: an arrow-like star, and in it a diamond that is a hole
_STAR = ((-9, -6), (0, -10), (9, -6), (4, 0), (9, 6), (0, 10), (-9, 6), (-4, 0))
_HOLE = ((-2, 0), (0, -3), (2, 0), (0, 3))
_MIDDLE = {"x": "CAST(({k}) * 7 % 31 * 10 - 150 AS DOUBLE)", "y": "CAST(({k}) * 11 % 13 * 10 - 60 AS DOUBLE)"}


def _ring(corners, key: str, size: str) -> str:
    """The SQL of a ring about the key's centre, for Spark."""
    x, y = (_MIDDLE[c].format(k=key) for c in "xy")
    return "array(" + ", ".join(f"named_struct('x', {x} + {i} * {size}, 'y', {y} + {j} * {size})" for i, j in corners) + ")"


def _shapes(df: DataFrame, key: str, size: str = "1.0") -> DataFrame:
    return df.select(key, F.expr(f"array({_ring(_STAR, key, size)}, {_ring(_HOLE, key, size)})").alias("shape"))


def _duck_edges(table: str, key: str, size: str = "1.0") -> str:
    """The same shapes' edges in DuckDB."""
    x, y = (_MIDDLE[c].format(k=key) for c in "xy")
    ends = [(a, b) for ring in (_STAR, _HOLE) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    rows = ", ".join(f"({i}, {j}, {u}, {v})" for (i, j), (u, v) in ends)
    return f"(SELECT {key}, {x} + a * {size} AS x1, {y} + b * {size} AS y1, {x} + c * {size} AS x2, {y} + d * {size} AS y2 FROM {table}, (VALUES {rows}) t(a, b, c, d))"


_ON = "(x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) = 0 AND px BETWEEN least(x1, x2) AND greatest(x1, x2) AND py BETWEEN least(y1, y2) AND greatest(y1, y2)"
_RAY = "(y1 <= py) <> (y2 <= py) AND px < x1 + (x2 - x1) * (py - y1) / nullif(y2 - y1, 0)"
_INSIDE = f"bool_or({_ON}) OR count(*) FILTER (WHERE {_RAY}) % 2 = 1"


@query(f"""SELECT n_nationkey, c_custkey FROM (SELECT c_custkey, CAST({_LON.format(k="c_custkey")} AS DOUBLE) AS px, CAST({_LAT.format(k="c_custkey")} AS DOUBLE) AS py FROM customer),
{_duck_edges("nation", "n_nationkey")} GROUP BY n_nationkey, c_custkey HAVING {_INSIDE}""")
def g4_contains(t):
    """Customers in shapes of nations."""
    return spatial.contains(_points(t("customer"), "c_custkey", "c"), _shapes(t("nation"), "n_nationkey"), ("c_lon", "c_lat"), "n_nationkey", "shape", 2.0).select("n_nationkey", "c_custkey")


@query(f"""{_POINTS}, d AS (SELECT c_custkey, s_suppkey, round({_KM.format(a="c", b="s")}, 6) AS km FROM c, s)
SELECT c_custkey, s_suppkey, round(km, 3) AS km, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) AS rank FROM d) WHERE rank <= 3""")
def g4_nearest(t):
    """The three suppliers nearest to each customer."""
    c, s = _points(t("customer"), "c_custkey", "c"), _points(t("supplier"), "s_suppkey", "s")
    out = spatial.nearest(c, s, ("c_lat", "c_lon"), ("s_lat", "s_lon"), "c_custkey", "s_suppkey", 3)
    return out.select("c_custkey", "s_suppkey", F.round("km", 3).alias("km"), "rank")


_TURN = "sign(({b}x - {a}x) * ({c}y - {a}y) - ({b}y - {a}y) * ({c}x - {a}x))"


def _crossing() -> str:
    turn = lambda a, b, c: _TURN.format(a=a, b=b, c=c)
    meet = f"{turn('e', 'f', 'g')} * {turn('e', 'f', 'h')} <= 0 AND {turn('g', 'h', 'e')} * {turn('g', 'h', 'f')} <= 0"
    return meet + "".join(f" AND least(e{v}, f{v}) <= greatest(g{v}, h{v}) AND least(g{v}, h{v}) <= greatest(e{v}, f{v})" for v in "xy")


_SIZE = "(0.25 + s_suppkey % 4 * 0.125)"


@query(f"""WITH l AS {_duck_edges("nation", "n_nationkey")}, r AS {_duck_edges("supplier", "s_suppkey", _SIZE)},
crossed AS (SELECT DISTINCT n_nationkey, s_suppkey FROM (SELECT n_nationkey, x1 AS ex, y1 AS ey, x2 AS fx, y2 AS fy FROM l), (SELECT s_suppkey, x1 AS gx, y1 AS gy, x2 AS hx, y2 AS hy FROM r) WHERE {_crossing()}),
inner_r AS (SELECT DISTINCT n_nationkey, s_suppkey FROM (SELECT n_nationkey, s_suppkey, px, py FROM l, (SELECT s_suppkey, x1 AS px, y1 AS py FROM r) GROUP BY ALL HAVING {_INSIDE})),
inner_l AS (SELECT DISTINCT n_nationkey, s_suppkey FROM (SELECT n_nationkey, s_suppkey, px, py FROM r, (SELECT n_nationkey, x1 AS px, y1 AS py FROM l) GROUP BY ALL HAVING {_INSIDE}))
FROM crossed UNION FROM inner_r UNION FROM inner_l""")
def g4_intersects(t):
    """Shapes of nations and smaller ones of suppliers that have a point in common."""
    return spatial.intersects(_shapes(t("nation"), "n_nationkey"), _shapes(t("supplier"), "s_suppkey", _SIZE), "n_nationkey", "s_suppkey", "shape", "shape", 4.0)


# a path for each region: bends about its own latitude
_BENDS = ((-170, 0), (-90, 12), (-90, -12), (0, 3), (45, 3), (170, -7))
_PATH_Y = "CAST({k} * 25 - 50 AS DOUBLE)"
_AT_ORDER = {"x": "CAST(o_orderkey * 104729 % 36000 / 100.0 - 180 AS DOUBLE)", "y": "CAST(o_orderkey * 7919 % 17900 / 100.0 - 89.5 AS DOUBLE)"}
_SEGMENTS = ", ".join(f"({a}, {b}, {c}, {d})" for (a, b), (c, d) in zip(_BENDS, _BENDS[1:], strict=False))


@query(f"""SELECT r_regionkey, o_orderkey, round(min(sqrt(power(px - (x1 + f * (x2 - x1)), 2) + power(py - (y1 + f * (y2 - y1)), 2))), 6) AS distance FROM (
SELECT *, least(1.0, greatest(0.0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2)))) AS f FROM (SELECT o_orderkey, {_AT_ORDER["x"]} AS px, {_AT_ORDER["y"]} AS py FROM orders),
(SELECT r_regionkey, CAST(a AS DOUBLE) AS x1, {_PATH_Y.format(k="r_regionkey")} + b AS y1, CAST(c AS DOUBLE) AS x2, {_PATH_Y.format(k="r_regionkey")} + d AS y2 FROM region, (VALUES {_SEGMENTS}) v(a, b, c, d)))
GROUP BY r_regionkey, o_orderkey HAVING min(sqrt(power(px - (x1 + f * (x2 - x1)), 2) + power(py - (y1 + f * (y2 - y1)), 2))) <= 1.25""")
def g4_corridor(t):
    """Orders within a corridor along the regions' paths."""
    lat, lon = _degrees("o_orderkey")
    orders = t("orders").select("o_orderkey", lon.alias("x"), lat.alias("y"))
    y = _PATH_Y.format(k="r_regionkey")
    paths = t("region").select("r_regionkey", F.expr("array(" + ", ".join(f"named_struct('x', {i}D, 'y', {y} + {j})" for i, j in _BENDS) + ")").alias("path"))
    out = spatial.corridor(orders, paths, ("x", "y"), "o_orderkey", "r_regionkey", "path", 1.25)
    return out.select("r_regionkey", "o_orderkey", F.round("distance", 6).alias("distance"))


def _duck_grid() -> str:
    """Transverse Mercator in DuckDB, with the series written out."""
    east, north = "eta", "xi"
    for j, a in enumerate(spatial.ALPHA, 1):
        east += f" + {a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)"
        north += f" + {a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)"
    e, scale = repr(spatial._E), repr(spatial.SCALE * spatial.RADIUS)
    return f"""SELECT c_custkey, round({spatial.EAST} + {scale} * ({east}), 3) AS east, round({scale} * ({north}), 3) AS north, round(c_lat, 2) AS lat, round(c_lon, 2) AS lon FROM (
SELECT *, atan2(t, cos(along)) AS xi, atanh(sin(along) / sqrt(1 + t * t)) AS eta FROM (
SELECT *, sinh(atanh(sin(radians(c_lat))) - {e} * atanh({e} * sin(radians(c_lat)))) AS t, radians(c_lon - meridian) AS along FROM (SELECT *, floor(c_lon / 6) * 6 + 3 AS meridian FROM c)))"""


@query(f"{_POINTS} {_duck_grid()}")
def g4_projection(t):
    """Customers on the grid of their six-degree zone, and back."""
    c = _points(t("customer"), "c_custkey", "c").withColumn("meridian", F.floor(F.col("c_lon") / 6) * 6 + 3)
    out = spatial.from_grid(spatial.to_grid(c, "c_lat", "c_lon", "meridian").drop("c_lat", "c_lon"), "east", "north", "meridian")
    return out.select("c_custkey", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"), F.round("lat", 2).alias("lat"), F.round("lon", 2).alias("lon"))


# ------------------------------------------------------------ H. functions of the user's own


@query("SELECT p_partkey, CAST(floor(p_retailprice * 100) AS BIGINT) AS cents FROM part")
def h1_pandas_udf(t):
    return t("part").select("p_partkey", udf.cents("p_retailprice").alias("cents"))


@query("""SELECT c_nationkey, round(sum(power(n / total, 2)), 6) AS concentration FROM (SELECT c_nationkey, count(*) AS n, sum(count(*)) OVER (PARTITION BY c_nationkey) AS total
FROM customer GROUP BY c_nationkey, c_mktsegment) GROUP BY 1""")
def h2_grouped_udf(t):
    """Counted by segment before, so that a group in Python is as long as there are segments."""
    counts = t("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("c_nationkey").agg(F.round(udf.concentration("n"), 6).alias("concentration"))


@query("SELECT p_partkey, CAST(i - 1 AS BIGINT) AS pos, w AS word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)")
def h3_table_function(t):
    return t("part").lateralJoin(udf.words(F.col("p_name").outer())).select("p_partkey", "pos", "word")


def h4_arrow_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders through Arrow files and back: a sink, and a source that takes columns and filters, both in Python."""
    from quern.sources.arrow_files import read_arrow, write_arrow

    orders, at = table(spark, sf_dir, "orders"), scratch(spark)
    write_arrow(orders, at)
    wanted = orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate").schema
    return read_arrow(spark, at, wanted).where("o_orderstatus <> 'F' AND o_orderkey >= 100 AND o_totalprice > 1000")


QUERIES["h4_arrow_source"] = h4_arrow_source
ORACLES["h4_arrow_source"] = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey >= 100 AND o_totalprice > 1000"


def h4_arrow_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of Arrow files, stopped after the even ones and gone on with from its offset."""
    from quern.sources.arrow_files import stream_arrow, write_arrow
    from quern.streaming import drain

    e, at, run = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), scratch(spark), scratch(spark)
    for odd in (0, 1):
        write_arrow(e.where(F.col("event_id") % 2 == odd), at)
        out = drain(stream_arrow(spark, at, e.schema), at=run)
    return out


QUERIES["h4_arrow_stream"] = h4_arrow_stream
ORACLES["h4_arrow_stream"] = "SELECT event_id, user_id, ts, value FROM events"


# ------------------------------------------------------------ streams, run to their end


def _streamed(name: str, build, sql: str | None = None, mode: str = "append", keys: tuple[str, ...] = ()) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from quern.streaming import drain, events

        return drain(build(events(spark, sf_dir)), mode, keys=keys)

    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _streams() -> None:
    from quern import streaming as S

    start = lambda df: df.withColumn("start", F.col("start").cast("timestamp_ntz"))
    _streamed("f4_stream_tumbling", lambda e: start(S.tumbling(e, "1 hour")), "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events GROUP BY 1", "complete")
    _streamed("f5_stream_sessions", lambda e: start(S.sessions(e, "30 minutes")), ORACLES["f3_session_window"], "complete")
    _streamed("f6_stream_dedup", lambda e: S.first_seen(e).select("user_id"), "SELECT DISTINCT user_id FROM events")
    _streamed("f7_stream_interval_join", lambda e: S.views_before_clicks(e), """SELECT v.event_id AS view_id, c.event_id AS click_id FROM events v JOIN events c ON v.user_id = c.user_id
AND c.ts >= v.ts AND c.ts <= v.ts + INTERVAL 30 MINUTE WHERE v.event_type = 'view' AND c.event_type = 'click'""")
    _streamed("f9_stream_state", lambda e: S.totals(e), "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1", "update", ("user_id",))

    _streamed("f8_stream_processor", lambda e: S.totals_processor(e), ORACLES["f9_stream_state"], "update", ("user_id",))
    _streamed("a5_stream_scan", lambda e: e.select("event_id", "user_id", "event_type", "value"), "SELECT event_id, user_id, event_type, value FROM events")
    QUERIES["f10_stream_late"] = S.late_rows
    ORACLES["f10_stream_late"] = """WITH e AS (SELECT *, time_bucket(INTERVAL '1 hour', ts) AS start FROM events),
m AS (SELECT max(ts) - INTERVAL 1 HOUR AS last, max(ts) FILTER (WHERE event_id % 10 <> 0) - INTERVAL 1 HOUR AS mark FROM e)
SELECT start, count(*) AS n FROM e, m WHERE start + INTERVAL 1 HOUR <= last AND (event_id % 10 <> 0 OR start + INTERVAL 1 HOUR > mark) GROUP BY 1"""
    _streamed("f8_timed_sessions", lambda e: start(S.timed_sessions(e)), """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s, max(ts) OVER () AS newest FROM
(SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s, newest
HAVING max(ts) + INTERVAL 30 MINUTE <= date_trunc('milliseconds', newest) - INTERVAL 1 HOUR""")
    QUERIES["f11_stream_upsert"] = S.users_upserted
    ORACLES["f11_stream_upsert"] = "SELECT user_id, count(*) AS n, max(ts) AS latest, round(sum(value), 2) AS total FROM events GROUP BY 1"
    QUERIES["f10_late_kept"] = S.late_kept
    ORACLES["f10_late_kept"] = """WITH e AS (SELECT *, time_bucket(INTERVAL '1 hour', ts) AS start FROM events),
m AS (SELECT max(ts) FILTER (WHERE event_id % 10 <> 0) - INTERVAL 1 HOUR AS mark FROM e)
SELECT start, count(*) FILTER (WHERE event_id % 10 <> 0 OR start + INTERVAL 1 HOUR > mark) AS on_time, count(*) FILTER (WHERE event_id % 10 = 0 AND start + INTERVAL 1 HOUR <= mark) AS late FROM e, m GROUP BY 1"""


_streams()
