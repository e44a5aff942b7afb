"""Joins of shapes against brute force in exact fractions, the projection against known places, bands of doubles by hypothesis."""

import math
import random
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators import joins, spatial

SHAPE = "array<array<struct<x: double, y: double>>>"
SHAPES = {
    1: [[(0, 0), (8, 0), (8, 8), (0, 8)], [(2, 2), (6, 2), (6, 6), (2, 6)]],  # with a hole
    2: [[(3, 3), (5, 3), (4, 5)]],  # in that hole
    3: [[(2, 2), (4, 2), (4, 4), (2, 4)]],  # touches the hole's corner from within it
    4: [[(10, 0), (14, 4), (10, 8), (12, 4)]],  # a bent arrow
    5: [[(8, 8), (9, 9), (8, 9)]],  # touches 1 in a vertex
    6: [[(-50, -50), (50, -50), (50, 50), (-50, 50)]],  # holds all
    7: [[(20.5, 0.25), (20.5, 3.75)]],  # flat: a line
    8: [[(12, 4)]],  # a point
    9: [],
    10: None,
    11: [[(-1, 3), (9, 3), (9, 3.5), (-1, 3.5)]],  # through 1, edges cross
    12: [[(30, 30), (31, 30), (31, 31), (30, 31)], [(33, 30), (34, 30), (34, 31), (33, 31)]],  # two parts
    13: [[(33.25, 30.25), (33.75, 30.25), (33.5, 30.75)]],  # in the second part
    14: [[]],
}
VERTICES = [p for s in SHAPES.values() for ring in s or [] for p in ring]


def edges(shape):
    return [(a, b) for ring in shape or [] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]


def side(a, b, p):
    ax, ay, bx, by, px, py = map(Fraction, (*a, *b, *p))
    v = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    return (v > 0) - (v < 0)


def on(a, b, p):
    return side(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def holds(shape, p):
    if any(on(a, b, p) for a, b in edges(shape)):
        return True
    up = [(a, b) if a[1] <= b[1] else (b, a) for a, b in edges(shape) if (a[1] <= p[1]) != (b[1] <= p[1])]
    return sum(side(a, b, p) > 0 for a, b in up) % 2 == 1


def meet(a, b, c, d):
    boxes = all(min(a[i], b[i]) <= max(c[i], d[i]) and min(c[i], d[i]) <= max(a[i], b[i]) for i in (0, 1))
    return boxes and side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0


def frame(spark, shapes):
    return spark.createDataFrame([(k, None if s is None else [[tuple(map(float, p)) for p in ring] for ring in s]) for k, s in shapes.items()], f"k int, shape {SHAPE}")


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("cell", [0.75, 2.0, 1000.0])
def test_contains_is_brute_force(spark, cell):
    r = random.Random(1)
    spots = [*VERTICES, *((r.randint(-4, 60) / 4, r.randint(-4, 60) / 4) for _ in range(400)), *((r.uniform(-55, 55), r.uniform(-55, 55)) for _ in range(200))]
    spots += [(None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0), (33.5, 30.5), (20.5, 2.0)]
    points = spark.createDataFrame([(i, None if x is None else float(x), float(y)) for i, (x, y) in enumerate(spots)], "i int, x double, y double")
    out = spatial.contains(points, frame(spark, SHAPES), ("x", "y"), "k", "shape", cell)
    assert out.columns == ["i", "x", "y", "k"] and "NestedLoop" not in plan_of(out) and "Cartesian" not in plan_of(out)
    some = [(i, p) for i, p in enumerate(spots) if p[0] is not None and math.isfinite(p[0])]
    assert sorted((x.i, x.k) for x in out.collect()) == sorted((i, k) for i, p in some for k, s in SHAPES.items() if holds(s, p))


@pytest.mark.parametrize("cell", [1.5, 200.0])
def test_intersects_is_brute_force(spark, cell):
    r = random.Random(2)
    more = {100 + i: [[(r.randint(0, 30) + dx * r.randint(1, 4), r.randint(0, 16) + dy * r.randint(1, 4)) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]] for i in range(25)}
    shapes = SHAPES | more
    left, right = frame(spark, shapes), frame(spark, shapes).withColumnRenamed("k", "j").withColumnRenamed("shape", "other")
    out = spatial.intersects(left, right, "k", "j", "shape", "other", cell)
    assert "NestedLoop" not in plan_of(out)

    def touch(s, t):
        if any(meet(*e, *f) for e in edges(s) for f in edges(t)):
            return True
        return any(holds(t, ring[0]) for ring in s or [] if ring) or any(holds(s, ring[0]) for ring in t or [] if ring)

    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(set(got))
    assert sorted(got) == sorted((k, j) for k, s in shapes.items() for j, t in shapes.items() if touch(s, t))


@pytest.mark.parametrize("width, cell", [(0.0, 1.0), (0.5, None), (3.0, 0.7), (40.0, None)])
def test_corridor_is_brute_force(spark, width, cell):
    r = random.Random(3)
    lines = {1: [(0, 0), (5, 5), (10, 0)], 2: [(3, 3)], 3: [], 4: None, 5: [(0, 2), (20, 2)], 6: [(1, 1), (1, 1), (1, 9)]}
    spots = [(r.randint(-8, 48) / 4, r.randint(-8, 48) / 4) for _ in range(150)] + [(2.5, 2.5), (3, 3)]

    def far(p, a, b):
        d, o = (b[0] - a[0], b[1] - a[1]), (p[0] - a[0], p[1] - a[1])
        size = d[0] ** 2 + d[1] ** 2
        f = min(1.0, max(0.0, (o[0] * d[0] + o[1] * d[1]) / size)) if size else 0.0
        return math.sqrt((p[0] - (a[0] + f * d[0])) ** 2 + (p[1] - (a[1] + f * d[1])) ** 2)

    want = {}
    for i, p in enumerate(spots):
        for k, line in lines.items():
            if line:
                d = min(far(p, a, b) for a, b in zip(line, line[1:] or line, strict=False))
                if d <= width:
                    want[i, k] = d
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spots)] + [(999, None, 1.0)], "i int, x double, y double")
    paths = spark.createDataFrame([(k, None if s is None else [tuple(map(float, p)) for p in s]) for k, s in lines.items()], "k int, path array<struct<x: double, y: double>>")
    out = spatial.corridor(points, paths, ("x", "y"), "i", "k", "path", width, cell)
    assert "NestedLoop" not in plan_of(out)
    got = {(x.i, x.k): x.distance for x in out.collect()}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-12 for p in want)


def great_circle(p, q):
    h = math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize("k", [1, 4, 100])
def test_nearest_is_brute_force(spark, k):
    r = random.Random(4)
    odd = [(90.0, 0.0), (-90.0, 10.0), (89.9, 179.9), (0.0, 180.0), (0.0, -180.0), (0.0, 179.999), (10.0, 10.0), (10.0, 10.0), (None, 1.0), (float("nan"), 1.0)]
    a = [*odd, *((r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(25))]
    b = [*odd, *((10.0, 10.0) for _ in range(8)), *((r.uniform(40, 41), r.uniform(-180, 180)) for _ in range(45))]  # most are in one band
    rows = lambda ps, n: spark.createDataFrame([(i, *p) for i, p in enumerate(ps)], f"{n} int, {n}x double, {n}y double")
    out = spatial.nearest(rows(a, "i"), rows(b, "j"), ("ix", "iy"), ("jx", "jy"), "i", "j", k)
    good = lambda p: p[0] is not None and p[0] == p[0]
    want = []
    for i, p in enumerate(a):
        if good(p):
            best = sorted((round(great_circle(p, q), 6), j) for j, q in enumerate(b) if good(q))[:k]
            want += [(i, j, n) for n, (_, j) in enumerate(best, 1)]
    assert sorted((x.i, x.j, x["rank"]) for x in out.collect()) == sorted(want)


def test_nearest_sorts_few_pairs_in_a_task(spark, monkeypatch):
    """All pairs are of few cells, and none is near until the radius has grown to them all."""
    monkeypatch.setattr(spatial, "SORTED_PAIRS", 300, raising=False)
    most, near = [], spatial.near

    def watched(*args):
        met = near(*args)
        most.append(max((x["count"] for x in met.groupBy(F.spark_partition_id()).count().collect()), default=0))
        return met

    monkeypatch.setattr(spatial, "near", watched)
    r = random.Random(6)
    spots = lambda n, x: [(i, x + r.random() / 10, r.random() / 10) for i in range(n)]
    a, b = spots(60, 0.0), spots(200, 50.0)
    left, right = spark.createDataFrame(a, "i int, ix double, iy double"), spark.createDataFrame(b, "j int, jx double, jy double")
    out = spatial.nearest(left, right, ("ix", "iy"), ("jx", "jy"), "i", "j", 3).collect()
    want = [(i, j, n) for i, *p in a for n, (_, j) in enumerate(sorted((round(great_circle(p, q), 6), j) for j, *q in b)[:3], 1)]
    assert sorted((x.i, x.j, x["rank"]) for x in out) == sorted(want)
    assert 0 < max(most) < 2400  # of 12,000


def test_nearest_of_nothing(spark):
    some = spark.createDataFrame([(1, 0.0, 0.0)], "i int, x double, y double")
    none = some.where("i > 1").toDF("j", "u", "v")
    assert spatial.nearest(some, none, ("x", "y"), ("u", "v"), "i", "j", 3).collect() == []
    assert spatial.nearest(none, some, ("u", "v"), ("x", "y"), "j", "i", 3).collect() == []


def test_projection_round_trip_and_known_place(spark):
    r = random.Random(5)
    rows = [(i, r.uniform(-84, 84), r.uniform(-35, 35)) for i in range(500)] + [(900, 0.0, 0.0), (901, 90.0, 3.0), (902, -90.0, 3.0), (903, 0.0, 30.0)]
    df = spark.createDataFrame(rows, "i int, y double, x double").withColumn("m", F.lit(3.0))
    back = spatial.from_grid(spatial.to_grid(df, "y", "x", "m"), "east", "north", "m").collect()
    for b in back:
        along = abs(b.lon - b.x) if abs(b.y) < 89.9 else 0
        # the series to the fourth power is good to a millimetre within some 30 degrees of the meridian
        bound = 1e-3 if abs(b.x - 3) < 30 else 1e-1
        assert (abs(b.lat - b.y) + along * math.cos(math.radians(b.y))) * 111_200 < bound, b
    # on the meridian the north is the length of its arc, 0.9996 of the quadrant at the pole
    pole = next(b for b in back if b.i == 901)
    assert abs(pole.east - 500000) < 1e-6 and abs(pole.north - 0.9996 * 10001965.729) < 1e-2


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.data())
def test_band_of_doubles_is_the_plain_join(spark, data):
    width = data.draw(st.sampled_from([1.0, 0.1, 0.3, 1e-9, 7.0]))
    near = st.one_of(st.floats(-5, 5), st.integers(-20, 20).map(lambda i: i * width), st.integers(-20, 20).map(lambda i: math.nextafter(i * width, -math.inf)), st.floats(allow_infinity=True, allow_nan=True))
    a, b = data.draw(st.lists(near, max_size=12)), data.draw(st.lists(near, max_size=12))
    left, right = spark.createDataFrame(list(enumerate(a)), "i int, x double"), spark.createDataFrame(list(enumerate(b)), "j int, y double")
    close = (F.col("y") >= F.col("x")) & (F.col("y") <= F.col("x") + F.lit(width))
    got = sorted(map(tuple, joins.band(left, right, "x", "y", width, close).select("i", "j").collect()))
    assert got == sorted(map(tuple, left.crossJoin(right).where(close).select("i", "j").collect()))


def test_band_of_large_integers_and_of_no_width(spark):
    big = 2**60
    left, right = spark.createDataFrame([(0, big + 1), (1, big - 1)], "i int, x long"), spark.createDataFrame([(j, big + j) for j in range(-3, 130)], "j int, y long")
    close = (F.col("y") >= F.col("x")) & (F.col("y") <= F.col("x") + F.lit(100))
    got = sorted((r.i, r.j) for r in joins.band(left, right, "x", "y", 100, close).collect())
    assert got == sorted((i, j) for i, x in ((0, 1), (1, -1)) for j in range(-3, 130) if x <= j <= x + 100)
    with pytest.raises(ValueError):
        joins.band(left, right, "x", "y", 0, close)


def test_distance_join_of_equal_places(spark):
    a = spark.createDataFrame([(1, 10.0, 20.0), (2, 90.0, 5.0), (3, 0.0, 180.0)], "i int, x double, y double")
    b = spark.createDataFrame([(1, 10.0, 20.0), (2, 90.0, 77.0), (3, 0.0, -180.0), (4, 10.0, 20.00001)], "j int, u double, v double")
    assert sorted((r.i, r.j) for r in joins.near(a, b, ("x", "y"), ("u", "v"), 0).collect())[:1] == [(1, 1)]
    with pytest.raises(ValueError):
        joins.near(a, b, ("x", "y"), ("u", "v"), -1)
