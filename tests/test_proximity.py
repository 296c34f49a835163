import math
import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from tesselith.operators import proximity as P


def test_ear_clip():
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    assert len(P.ear_clip(square)) == 2
    assert len(P.ear_clip(square[::-1] + [square[-1]])) == 2  # clockwise and closed
    concave = [(0, 0), (6, 0), (6, 6), (3, 1), (0, 6)]
    tris = P.ear_clip(concave)
    area = sum(((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / 2 for a, b, c in tris)
    assert len(tris) == 3 and area == 21
    assert P.ear_clip([(0, 0), (1, 1)]) == [] and P.ear_clip([(0, 0), (1, 1), (2, 2)]) == []
    assert P.ear_clip([(0, 0), (1, 0), (None, 1)]) == [] and P.ear_clip([(0, 0), (1, 0), (math.nan, 1)]) == [] and P.ear_clip([]) == []
    tris = P.ear_clip([(0, 0), (2, 0), (4, 0), (4, 4), (4, 4), (0, 4)])  # collinear and repeated vertices
    assert sum(((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / 2 for a, b, c in tris) == 16


def inside_ring(ring, x, y):
    """Half-open crossing rule."""
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay <= y < by) or (by <= y < ay):
            if x < ax + (y - ay) * (bx - ax) / (by - ay):
                hit = not hit
    return hit


def star(rng, cx, cy):
    return [(cx + r * math.cos(a), cy + r * math.sin(a)) for a, r in ((2 * math.pi * i / 9, rng.uniform(2, 9)) for i in range(9))]


def frames(spark, regions, points):
    r = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in ring], t1, t2) for i, ring, t1, t2 in regions], "region_id bigint, ring array<struct<x:double,y:double>>, t1 double, t2 double")
    return r, spark.createDataFrame(points, "point_id bigint, t double, x double, y double")


@pytest.mark.parametrize("bound", [1000, 0])
def test_regions_of_polygons(spark, bound):
    rng = random.Random(3)
    regions = [(i, star(rng, rng.uniform(0, 60), rng.uniform(0, 60)), 0.0, rng.uniform(2, 10)) for i in range(40)]
    points = [(i, rng.uniform(0, 10), rng.uniform(0, 60), rng.uniform(0, 60)) for i in range(600)]
    want = {(i, p) for i, ring, t1, t2 in regions for p, t, x, y in points if t1 <= t < t2 and inside_ring(ring, x, y)}
    r, p = frames(spark, regions, points)
    got = [(x["region_id"], x["point_id"]) for x in P.regions_of(p, r, bound=bound, leaf_rows=60, slice_rows=40).collect()]
    assert len(want) > 100 and set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("bound", [1000, 0])
def test_shared_boundaries(spark, bound):
    boxes = [(i * 3 + j, 0.0, float(i), float(j), 1.0, i + 1.0, j + 1.0) for i in range(3) for j in range(3)]
    zones = spark.createDataFrame(boxes, "zone_id bigint, t1 double, x1 double, y1 double, t2 double, x2 double, y2 double")
    points = [(k, 0.0, a / 2, b / 2) for k, (a, b) in enumerate((a, b) for a in range(7) for b in range(7))]
    points += [(90, 1.0, 0.5, 0.5), (91, 0.5, None, 0.5), (92, 0.5, math.nan, 0.5), (None, 0.5, 0.5, 0.5), (93, 0.5, math.inf, 0.5), (0, 0.0, 0.0, 0.0)]
    p = spark.createDataFrame(points, "point_id bigint, t double, x double, y double")
    got = [(x["region_id"], x["point_id"]) for x in P.regions_of(p, P.rings_of_boxes(zones, "zone_id"), bound=bound).collect()]
    want = {(z, k) for z, t1, x1, y1, t2, x2, y2 in boxes for k, t, x, y in points if None not in (k, x) and t1 <= t < t2 and x1 <= x < x2 and y1 <= y < y2}
    assert set(got) == want and len(got) == len(want) == 36


def test_boxes_that_contain_nothing(spark):
    nan = math.nan
    rows = [(1, 0, 0, 0, 0, 1, 1), (2, 0, 1, 0, 1, 0, 1), (3, 0, 0, 0, 1, 1, None), (4, 0, nan, 0, 1, 1, 1), (None, 0, 0, 0, 1, 1, 1), (5, 0, 0, 0, 1, 1, 1), (6, 0, 0, 0, 1, 1, nan)]
    z = spark.createDataFrame([(r[0], *(None if v is None else float(v) for v in r[1:])) for r in rows], "zone_id bigint, t1 double, x1 double, y1 double, t2 double, x2 double, y2 double")
    assert [r["region_id"] for r in P.rings_of_boxes(z, "zone_id").collect()] == [5]


def test_hierarchy_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 100, (500, 2)).astype(float)
    tri = np.column_stack([a, a + [7, 0], a + [0, 9], np.zeros(500), rng.integers(1, 9, 500)])
    p = np.column_stack([rng.integers(0, 8, 2000), rng.integers(0, 110, (2000, 2))]).astype(float)
    row, region = P.Hierarchy(tri, np.arange(500)).locate(p)
    want = {(i, j) for j in range(500) for i in np.flatnonzero(P.in_triangle(p, np.repeat(tri[j : j + 1], len(p), 0)))}
    assert set(zip(row, region)) == want and want
    assert len(P.Hierarchy(np.empty((0, 8)), np.empty(0, int)).locate(p)[0]) == 0


@pytest.mark.parametrize("leaf_rows,slice_rows", [(10**6, 10**6), (50, 10**6), (50, 25)])
def test_near(spark, leaf_rows, slice_rows):
    rng = random.Random(5)
    pts = [(i, rng.randrange(0, 400) / 4 - 50, rng.randrange(0, 400) / 4 - 50, rng.randrange(0, 400) / 4 - 50) for i in range(700)]
    pts += [(i, 0.0, 0.0, 0.0) for i in range(700, 730)] + [(800, 25.0, 0.0, 0.0), (801, 25.0625, 0.0, 0.0), (802, -25.0, 0.0, 0.0)]
    want = {(a, b) for a, *u in pts for b, *v in pts if a < b and math.sqrt(sum((p - q) ** 2 for p, q in zip(u, v))) <= 10}
    rows = pts + pts[:50] + [(900, None, 0.0, 0.0), (901, math.nan, 0.0, 0.0), (None, 0.0, 0.0, 0.0), (902, math.inf, 0.0, 0.0), (903, 1e300, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "point_id bigint, t double, x double, y double")
    got = [(r["a_id"], r["b_id"]) for r in P.near_pairs(df, 10.0, leaf_rows, slice_rows).collect()]
    assert set(got) == want and len(got) == len(want)
    both = {(a, b) for a, *u in pts if a % 3 for b, *v in pts if b % 2 == 0 and math.sqrt(sum((p - q) ** 2 for p, q in zip(u, v))) <= 10}
    got = [tuple(r) for r in P.distance_join(df.where("point_id % 3 > 0"), df.where("point_id % 2 = 0"), 10.0, leaf_rows, slice_rows).collect()]
    assert set(got) == both and len(got) == len(both)


def test_near_bounds_and_empty(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 25.0, 0.0, 0.0), (3, 0.0, 24.0, 7.0625), (1, 500.0, 0.0, 0.0), (4, 500.0, 0.0, 1.0)], "point_id bigint, t double, x double, y double").selectExpr("*", "1 as ct", "2 as task", "3 as role")
    assert sorted((r["a_id"], r["b_id"]) for r in P.near_pairs(df, 25.0).collect()) == [(1, 2), (1, 4)]
    none = df.where("false")
    assert P.near_pairs(none, 25.0).count() == 0 and P.distance_join(none, df, 25.0).count() == 0 and P.distance_join(df, none, 25.0).count() == 0
    for bad in (0, math.inf, math.nan):
        with pytest.raises(ValueError):
            P.near_pairs(df, bad)
    zones = spark.createDataFrame(pd.DataFrame({"region_id": [1]})).selectExpr("region_id", "array(struct(0D as x, 0D as y)) ring", "0D t1", "1D t2")
    assert P.regions_of(df, zones).count() == 0 and P.regions_of(df.where("false"), zones.where("false")).count() == 0
    assert P.regions_of(df.where("false"), zones, bound=-1).count() == 0


def test_near_has_no_nested_loops(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "point_id bigint, t double, x double, y double")
    plan = P.near_pairs(df, 25.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_copies_and_one_place(spark):
    """A third of the rows are deliveries of one id, another third lie at one place: slices keep every pair."""
    df = spark.range(900).selectExpr("case when id % 3 = 0 then -1 else id end point_id", "case when id % 3 = 2 then 0.1D else id * 0.01D end t", "0.3D x", "0.7D y").where("point_id % 3 != 2 or point_id < 240 or point_id = -1")
    rows = {(r["point_id"], r["t"]) for r in df.collect()}
    want = {(min(a, b), max(a, b)) for a, s in rows for b, t in rows if a != b and abs(s - t) <= 0.05}
    got = [tuple(r) for r in P.near_pairs(df, 0.05, 40, 30).collect()]
    assert set(got) == want and len(got) == len(want)


def test_shared_edges_of_any_coordinates():
    """Points computed on the edges that four polygons share: each in exactly one of them."""
    rng = np.random.default_rng(7)
    centre, around = (0.1, 0.7), [(rng.uniform(-9, -1), rng.uniform(-9, -1)), (rng.uniform(1, 9), rng.uniform(-9, -1)), (rng.uniform(1, 9), rng.uniform(1, 9)), (rng.uniform(-9, -1), rng.uniform(1, 9))]
    rings = [[centre, around[i], (np.mean([around[i][0], around[(i + 1) % 4][0]]) * 1.5, np.mean([around[i][1], around[(i + 1) % 4][1]]) * 1.5), around[(i + 1) % 4]] for i in range(4)]
    tri, ids = zip(*[((*a, *b, *c, 0.0, 1.0), i) for i, ring in enumerate(rings) for a, b, c in P.ear_clip(ring)])
    share = rng.uniform(0.0, 0.999, (4, 5000, 1))
    pts = np.concatenate([np.array(centre) + s * (np.array(a) - np.array(centre)) for s, a in zip(share, around)] + [np.array([centre])])
    row, _ = P.Hierarchy(np.array(tri), np.array(ids)).locate(np.column_stack([np.zeros(len(pts)), pts]))
    assert (np.bincount(row, minlength=len(pts)) == 1).all()


def test_exact_sides():
    third, e = 1 / 3, 2.0**-52
    for a, b, p in [((0, 0), (0.1 * 3, 0.3), (0.1, 0.1)), ((third, third), (third * 3, 1), (0.5, 0.5)), ((12, 12), (24, 24), (0.5, 0.5 + e)), ((12, 12), (24, 24), (0.5 + e, 0.5)), ((0.1, 0.2), (0.3, 0.6), (0.2, 0.4))]:
        (ax, ay), (bx, by), (px, py) = (tuple(map(Fraction, v)) for v in (a, b, p))
        det = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
        want = (det > 0) - (det < 0)
        assert P.sides(*[np.array([float(v)]) for v in (*a, *b, *p)])[0] == want == P._turn(a, b, p)


def gear(n):
    return [((10 if i % 2 else 9) * math.cos(2 * math.pi * i / n), (10 if i % 2 else 9) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def test_faulty_rings_have_no_triangles(spark):
    star = [(math.cos(4 * math.pi * i / 5), math.sin(4 * math.pi * i / 5)) for i in range(5)]
    bow = [(0, 0), (2, 2), (2, 0), (0, 2)]
    late = [(0, 0), (6, 0), (6, 1), (-1, 1), (-1, 4), (3, 4), (3, -2), (0, -2)]  # two crossings far from each other
    assert [P.clip_ring(r) for r in (star, bow, late)] == [([], "crosses itself")] * 3
    regions = [(1, star, 0.0, 1.0), (2, [(0, 0), (1, 0), (1, 1)], 0.0, 1.0), (3, [(0, 0), (1, 1), (2, 2)], 0.0, 1.0), (4, bow, 1.0, 1.0), (None, bow, 0.0, 1.0), (5, [(0, 0), (None, 1), (2, 2)], 0.0, 1.0), (6, bow, None, 1.0), (7, None, 0.0, 1.0)]
    r = spark.createDataFrame([(i, ring and [{"x": None if x is None else float(x), "y": float(y)} for x, y in ring], s, t) for i, ring, s, t in regions], "region_id bigint, ring array<struct<x:double,y:double>>, t1 double, t2 double").selectExpr("*", "1 as early", "2 as fault")
    assert {(x["region_id"], x["fault"]) for x in P.region_faults(r).collect()} == {(1, "crosses itself"), (3, "no area"), (4, "no time"), (None, "no id"), (5, "incomplete vertex"), (6, "no time"), (7, "no ring")}
    assert {x["region_id"] for x in P.triangulate(r).collect()} == {2}


def test_long_borders_take_seconds():
    import time

    began = time.monotonic()
    tris = P.ear_clip(gear(8000))
    assert len(tris) == 7998 and time.monotonic() - began < 20
    area = sum(((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / 2 for a, b, c in tris)
    assert area == pytest.approx(8000 * 90 * math.sin(2 * math.pi / 8000) / 2)
