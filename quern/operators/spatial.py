"""Joins of points, lines and polygons through grids of cells, and a map projection; built-in functions only.

A polygon is an array of rings, a ring an array of structs (x, y); what an odd number of
rings encloses is inside (so a ring in a ring is a hole), and the boundary belongs to the
polygon. Rings close themselves. A line is one array of (x, y). Coordinates are those of a
plane: shapes across the date line must be cut there. The cell is a parameter: with cells
about as large as typical shapes, or as the distance between points, a cell holds few of
each; a shape is listed in every cell it touches, so far smaller cells multiply it.

Null shapes, rings without points and points with a null or non-finite coordinate are in
nothing and near nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.joins import EARTH_KM, near
from quern.plans import written

_SLACK = 1e-9  # of a cell: a shape this near to a cell is listed in it too
SORTED_PAIRS = 4_000_000  # pairs of a task of `nearest`, which sorts those within the radius for the k best of each position


def _floor(x: Column, cell: float) -> Column:
    return F.floor(x / F.lit(float(cell))).cast("long")


def _finite(*cols: str) -> Column:
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < F.lit(float("inf")))
    return ok


def _edges(shapes: DataFrame, keys: list[str], shape: str, closed: bool) -> DataFrame:
    """keys, x1, y1, x2, y2 of every edge; a ring (or line) of one point is an edge to itself."""
    rings = shapes.select(*keys, F.explode(shape).alias("__p")) if closed else shapes.select(*keys, F.col(shape).alias("__p"))
    n = F.size("__p")
    following = F.concat(F.slice("__p", 2, F.greatest(n - 1, F.lit(0))), F.slice("__p", 1, 1)) if closed else F.when(n == 1, F.col("__p")).otherwise(F.slice("__p", 2, F.greatest(n - 1, F.lit(0))))
    pairs = rings.where(n > 0).select(*keys, F.explode(F.filter(F.arrays_zip(F.col("__p").alias("a"), following.alias("b")), lambda e: e["b"].isNotNull())).alias("e"))
    e = pairs.select(*keys, *(F.col(f"e.{p}.{c}").cast("double").alias(f"{c}{i}") for p, i in (("a", 1), ("b", 2)) for c in "xy"))
    return e.where(_finite("x1", "y1", "x2", "y2"))


def _bands(edges: DataFrame, cell: float, reach: float = 0.0) -> DataFrame:
    """Edges by the bands of cells that come within `reach` of them, with the first and last cell of the band: __cy, __a, __b."""
    slack = reach + _SLACK * cell
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = edges.withColumn("__cy", F.explode(F.sequence(_floor(low - slack, cell), _floor(high + slack, cell))))
    # the part of the edge that the band, made wider by the reach, cuts out
    at = lambda y: F.col("x1") + (F.col("x2") - F.col("x1")) * F.when(F.col("y2") != F.col("y1"), (y - F.col("y1")) / (F.col("y2") - F.col("y1"))).otherwise(F.lit(0.0))
    ya = F.greatest(low, F.col("__cy") * F.lit(float(cell)) - slack)
    yb = F.least(high, (F.col("__cy") + 1) * F.lit(float(cell)) + slack)
    flat = F.col("y1") == F.col("y2")
    left = F.when(flat, F.least("x1", "x2")).otherwise(F.least(at(ya), at(yb)))
    right = F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest(at(ya), at(yb)))
    return e.withColumns({"__a": _floor(left - slack, cell), "__b": _floor(right + slack, cell)})


def _on_edge(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    side = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    return (side == 0) & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))


def _crosses(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Does a ray from the point towards larger x cross the edge? An edge holds its lower end only."""
    return ((y1 <= y) != (y2 <= y)) & (x < x1 + (x2 - x1) * (y - y1) / F.when(y2 != y1, y2 - y1))


def contains(points: DataFrame, polygons: DataFrame, at: tuple[str, str], key: str, shape: str, cell: float) -> DataFrame:
    """Every point with the key of each polygon that contains it; all columns of the points, then `key`.

    Cells that no edge touches are inside or outside as a whole: the point's cell says so.
    Only in cells of the boundary are rays counted, against the edges of that polygon in
    the point's band of cells. Polygons are told apart by `key`, which must be unique.
    """
    x, y = F.col(at[0]).cast("double"), F.col(at[1]).cast("double")
    p = points.where(_finite(*at)).withColumns({"__cx": _floor(x, cell), "__cy": _floor(y, cell)})
    bands = _bands(_edges(polygons.select(F.col(key).alias("__key"), shape), ["__key"], shape, True), cell)
    border = bands.select("__key", "__cy", F.explode(F.sequence("__a", "__b")).alias("__cx")).distinct()
    # crossings of the middle line of a band, in order: between an odd one and the next the line is inside
    middle = (F.col("__cy") + 0.5) * F.lit(float(cell))
    cuts = bands.where((F.col("y1") <= middle) != (F.col("y2") <= middle)).select("__key", "__cy", (F.col("x1") + (F.col("x2") - F.col("x1")) * (middle - F.col("y1")) / F.when(F.col("y2") != F.col("y1"), F.col("y2") - F.col("y1"))).alias("__x"))
    row = Window.partitionBy("__key", "__cy").orderBy("__x")
    spans = cuts.select("__key", "__cy", "__x", F.lead("__x").over(row).alias("__to"), F.row_number().over(row).alias("__n")).where("__n % 2 = 1")
    first, last = _floor(F.col("__x") - cell / 2, cell) + 1, _floor(F.col("__to") - cell / 2, cell)  # cells whose middle lies in the span
    inner = spans.where(last >= first).select("__key", "__cy", F.explode(F.sequence(first, last)).alias("__cx")).join(border, ["__key", "__cy", "__cx"], "left_anti")
    edge = F.struct("x1", "y1", "x2", "y2")
    in_band = bands.groupBy("__key", "__cy").agg(F.collect_list(edge).alias("__edges"))
    open_points = p.join(border, ["__cx", "__cy"]).join(in_band, ["__key", "__cy"])
    ends = lambda e: (x, y, e["x1"], e["y1"], e["x2"], e["y2"])
    odd = F.size(F.filter("__edges", lambda e: _crosses(*ends(e)))) % 2 == 1
    touched = open_points.where(odd | F.exists("__edges", lambda e: _on_edge(*ends(e))))
    out = [*points.columns, F.col("__key").alias(key)]
    return p.join(inner, ["__cx", "__cy"]).select(*out).unionAll(touched.select(*out))


def intersects(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_shape: str, right_shape: str, cell: float) -> DataFrame:
    """Pairs of keys of polygons that have a point in common, each once.

    Edges are cut at the bands of cells. Two of them meet in the band's first cell that
    both have, and only there are they compared. Shapes whose edges do not meet intersect
    where one contains the other: it then contains any vertex of each of its parts.
    """
    side = lambda df, k, s, p: _bands(_edges(df.select(F.col(k).alias("__key"), F.col(s).alias("__s")), ["__key"], "__s", True), cell).select("__cy", *(F.col(c).alias(p + c.strip("_")) for c in ("__key", "__a", "__b", "x1", "y1", "x2", "y2")))
    l, r = side(left, left_key, left_shape, "l_"), side(right, right_key, right_shape, "r_")
    l, r = (df.withColumn("__cx", F.explode(F.sequence(f"{p}a", f"{p}b"))) for df, p in ((l, "l_"), (r, "r_")))
    met = l.join(r, ["__cy", "__cx"]).where(F.col("__cx") == F.greatest("l_a", "r_a"))
    at = lambda p, i: (F.col(f"{p}x{i}"), F.col(f"{p}y{i}"))
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = at("l_", 1), at("l_", 2), at("r_", 1), at("r_", 2)
    turn = lambda px, py, qx, qy, rx, ry: F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))
    apart = (turn(ax, ay, bx, by, cx, cy) * turn(ax, ay, bx, by, dx, dy) > 0) | (turn(cx, cy, dx, dy, ax, ay) * turn(cx, cy, dx, dy, bx, by) > 0)
    boxes = (F.least(ax, bx) <= F.greatest(cx, dx)) & (F.least(cx, dx) <= F.greatest(ax, bx)) & (F.least(ay, by) <= F.greatest(cy, dy)) & (F.least(cy, dy) <= F.greatest(ay, by))
    crossed = met.where(boxes & ~apart).select("l_key", "r_key")

    def within(inner, ik, shape, outer, ok, oshape, names):
        rings = inner.select(F.col(ik).alias(names[0]), F.explode(shape).alias("__r")).where(F.size("__r") > 0)
        corner = rings.select(names[0], F.col("__r")[0]["x"].alias("__x"), F.col("__r")[0]["y"].alias("__y"))
        return contains(corner, outer.select(F.col(ok).alias(names[1]), F.col(oshape).alias("__o")), ("__x", "__y"), names[1], "__o", cell).select("l_key", "r_key")

    both = crossed.unionAll(within(left, left_key, left_shape, right, right_key, right_shape, ("l_key", "r_key")))
    both = both.unionAll(within(right, right_key, right_shape, left, left_key, left_shape, ("r_key", "l_key")))
    return both.distinct().select(F.col("l_key").alias(left_key), F.col("r_key").alias(right_key))


def corridor(points: DataFrame, lines: DataFrame, at: tuple[str, str], point_key: str, key: str, shape: str, width: float, cell: float | None = None) -> DataFrame:
    """Pairs of a point and a line at most `width` apart: point_key, key and distance, each pair once.

    A segment is listed in the cells that it passes within the width, and a point in its
    own, so only segments nearby are measured.
    """
    cell = float(cell or max(width, 1e-9))
    p = points.where(_finite(*at)).select(F.col(point_key).alias("__point"), F.col(at[0]).cast("double").alias("px"), F.col(at[1]).cast("double").alias("py"))
    p = p.withColumns({"__cx": _floor(F.col("px"), cell), "__cy": _floor(F.col("py"), cell)})
    s = _bands(_edges(lines.select(F.col(key).alias("__key"), shape), ["__key"], shape, False), cell, float(width)).withColumn("__cx", F.explode(F.sequence("__a", "__b")))
    far = segment_distance(*(F.col(c) for c in ("px", "py", "x1", "y1", "x2", "y2")))
    met = p.join(s, ["__cx", "__cy"]).withColumn("distance", far).where(F.col("distance") <= F.lit(float(width)))
    return met.groupBy(F.col("__point").alias(point_key), F.col("__key").alias(key)).agg(F.min("distance").alias("distance"))


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """From a point to the nearest point of a segment."""
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    along = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x1) * dx + (py - y1) * dy) / F.when(size > 0, size)))).otherwise(F.lit(0.0))
    ox, oy = px - (x1 + along * dx), py - (y1 + along * dy)
    return F.sqrt(ox * ox + oy * oy)


def nearest(left: DataFrame, right: DataFrame, left_at: tuple[str, str], right_at: tuple[str, str], left_key: str, right_key: str, k: int, digits: int = 6) -> DataFrame:
    """The k right points nearest to each left one on the sphere: left_key, right_key, km, rank; all where there are fewer.

    Positions are (latitude, longitude). Rings of cells grow: a round joins within its
    radius, and only left positions with fewer than k right points that near go on to the
    next, of twice the radius. So where points are dense the cells are small. Distances
    count to `digits` decimals of a kilometre; ties go to the smaller right key. Equal left positions
    are asked once, and of equal right positions only the k smallest keys can matter.
    """
    spark = left.sparkSession
    ok = lambda at: F.col(at[0]).between(-90, 90) & F.col(at[1]).between(-360, 360)
    r = right.where(ok(right_at)).select(F.col(right_at[0]).alias("r_lat"), F.col(right_at[1]).alias("r_lon"), F.col(right_key).alias("r_key"))
    by_key = Window.partitionBy("r_lat", "r_lon").orderBy("r_key")
    r = written(r.withColumn("__n", F.row_number().over(by_key)).where(F.col("__n") <= k).drop("__n"))
    open_ = written(left.where(ok(left_at)).select(F.col(left_at[0]).alias("l_lat"), F.col(left_at[1]).alias("l_lon")).distinct())
    places = r.select("r_lat", "r_lon").distinct().count()
    whole = math.pi * EARTH_KM
    # a quarter of the radius that holds k of evenly spread places
    km, slack, done = min(whole, EARTH_KM * math.sqrt(4 * k / max(places, 1)) / 4), 10.0**-digits, []
    while not open_.isEmpty():
        last = km >= whole
        # all points of the sphere lie within the last radius
        met = near(open_, r, ("l_lat", "l_lon"), ("r_lat", "r_lon"), km if not last else whole * 1.001, SORTED_PAIRS)
        met = met.withColumn("km", F.round(_km(), digits))
        # where a k-th distance is rounded up to the radius a nearer one may lie beyond it
        top = Window.partitionBy("l_lat", "l_lon").orderBy("km", "r_key")
        best = met.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
        best = written(best.select("l_lat", "l_lon", "r_key", "km", "rank"))
        full = best.where((F.col("rank") == k) & (F.col("km") < F.lit(km - slack))).select("l_lat", "l_lon")
        if last:
            done.append(best)
            break
        done.append(best.join(full, ["l_lat", "l_lon"], "left_semi"))
        open_ = written(open_.join(full, ["l_lat", "l_lon"], "left_anti"))
        km = min(whole, 2 * km)
    asked = left.where(ok(left_at)).select(F.col(left_key).alias("__key"), F.col(left_at[0]).alias("l_lat"), F.col(left_at[1]).alias("l_lon"))
    found = done[0] if done else spark.createDataFrame([], f"l_lat double, l_lon double, r_key {right.schema[right_key].dataType.simpleString()}, km double, rank int")
    for more in done[1:]:
        found = found.unionAll(more)
    return asked.join(found, ["l_lat", "l_lon"]).select(F.col("__key").alias(left_key), F.col("r_key").alias(right_key), "km", "rank")


def _km() -> Column:
    from quern.functions import great_circle

    return great_circle(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))


# ------------------------------------------------------------ transverse Mercator

AXIS, FLATTENING, SCALE, EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0  # fixed values: WGS 84 and UTM
_N = FLATTENING / (2 - FLATTENING)
RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = 2 * math.sqrt(_N) / (1 + _N)
# fixed values: coefficients of the series in the third flattening, to its fourth power
ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)


def to_grid(df: DataFrame, lat: str, lon: str, meridian: str, east: str = "east", north: str = "north") -> DataFrame:
    """Adds the place in metres on the transverse Mercator grid of a central meridian; all are columns in degrees, within some 40 of it.

    Built-in functions in columns one on another, so that nothing is written out twice in the plan.
    """
    s, along = F.sin(F.radians(F.col(lat))), F.radians(F.col(lon) - F.col(meridian))
    d = df.withColumns({"__s": s, "__along": along})
    d = d.withColumn("__t", F.sinh(F.atanh("__s") - F.lit(_E) * F.atanh(F.lit(_E) * F.col("__s"))))
    d = d.withColumns({"__xi": F.atan2("__t", F.cos("__along")), "__eta": F.atanh(F.sin("__along") / F.sqrt(1 + F.col("__t") * F.col("__t")))})
    x, y = _series(ALPHA)
    return d.withColumns({east: F.lit(EAST) + F.lit(SCALE * RADIUS) * x, north: F.lit(SCALE * RADIUS) * y}).drop("__s", "__along", "__t", "__xi", "__eta")


def _series(coefficients: tuple[float, ...]) -> tuple[Column, Column]:
    xi, eta = F.col("__xi"), F.col("__eta")
    x, y = eta, xi
    for j, a in enumerate(coefficients, 1):
        x = x + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return x, y


def from_grid(df: DataFrame, east: str, north: str, meridian: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds latitude and longitude in degrees of a place on that grid; the inverse of `to_grid`."""
    d = df.withColumns({"__xi": F.col(north) / F.lit(SCALE * RADIUS), "__eta": (F.col(east) - F.lit(EAST)) / F.lit(SCALE * RADIUS)})
    x, y = _series(tuple(-b for b in BETA))
    d = d.withColumns({"__x": x, "__y": y})
    # the tangent of the conformal latitude; from it that of the geographic one by Newton's steps
    d = d.withColumns({"__t": F.sin("__y") / F.sqrt(F.pow(F.sinh("__x"), F.lit(2.0)) + F.pow(F.cos("__y"), F.lit(2.0)))})
    d = d.withColumns({"__tau": F.col("__t"), lon: F.col(meridian) + F.degrees(F.atan2(F.sinh("__x"), F.cos("__y")))})
    tau = F.col("__tau")
    for _ in range(3):
        d = d.withColumn("__r", F.sqrt(1 + tau * tau))
        d = d.withColumn("__sg", F.sinh(F.lit(_E) * F.atanh(F.lit(_E) * tau / F.col("__r"))))
        d = d.withColumn("__h", tau * F.sqrt(1 + F.col("__sg") * F.col("__sg")) - F.col("__sg") * F.col("__r"))
        d = d.withColumn("__tau", tau + (F.col("__t") - F.col("__h")) / F.sqrt(1 + F.col("__h") * F.col("__h")) * (1 + (1 - _E**2) * tau * tau) / ((1 - _E**2) * F.col("__r")))
    return d.withColumn(lat, F.degrees(F.atan("__tau"))).drop("__xi", "__eta", "__x", "__y", "__t", "__tau", "__r", "__sg", "__h")
