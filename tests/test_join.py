import math
import random

import numpy as np
import pandas as pd
import pytest

from __spark_entry__ import queries
from tesselith.model import Box
from tesselith.operators import join as J

NAMES = [f"{a}{i}" for i in "12" for a in "txy"]
SCHEMA = "id bigint, " + ", ".join(f"{n} double" for n in NAMES)


def make(spark, n, seed, spread=8, big=0.05):
    rng, rows = random.Random(seed), []
    for i in range(n):
        low = [float(rng.randrange(-spread, spread)) for _ in range(3)]
        size = [rng.choice([0, 1, 2, 3]) for _ in range(3)] if rng.random() > big else [rng.choice([1, 40, 300]) for _ in range(3)]
        rows.append((i, *low, *(l + s for l, s in zip(low, size))))
    rows += [(n, None, 0.0, 0.0, 1.0, 1.0, 1.0), (n + 1, math.nan, 0.0, 0.0, 1.0, 1.0, 1.0), (n + 2, 5.0, 0.0, 0.0, 1.0, 9.0, 9.0), (n + 3, -math.inf, 0.0, 0.0, 1.0, 1.0, 1.0), rows[0]]
    return spark.createDataFrame(rows, SCHEMA), rows[:n] + rows[-1:]


def upright(rows):
    return [(r[0], Box(*r[1:])) for r in rows]


@pytest.mark.parametrize("widths", [None, (0.3, 7.0, 100.0), (1000.0, 1000.0, 1000.0)])
def test_intersects_join(spark, widths):
    a, ra = make(spark, 120, 1)
    b, rb = make(spark, 80, 2)
    want = sorted((i, j) for i, p in upright(ra) for j, q in upright(rb) if p.overlaps(q))
    got = J.intersects_join(a, b, widths)
    assert sorted((r["a_id"], r["b_id"]) for r in got.collect()) == want and len(want) > 100
    assert set(got.columns) == {f"{p}_{c}" for p in "ab" for c in a.columns}


def test_intersects_join_needs_no_nested_loop(spark):
    a, _ = make(spark, 20, 1)
    plan = J.intersects_join(a, a)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert J.intersects_join(a.where("false"), a).count() == 0 and J.intersects_join(a, a.where("false")).count() == 0


def test_huge_and_tiny_boxes_meet(spark):
    rows = [(1, -1e12, -1e12, -1e12, 1e12, 1e12, 1e12), (2, 0.0, 0.0, 0.0, 1e-6, 1e-6, 1e-6), (3, 5e-7, 5e-7, 5e-7, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["a_id"], r["b_id"]) for r in J.intersects_join(df, df, (1e-6, 1e-6, 1e-6)).where("a_id < b_id").collect())
    assert got == [(1, 2), (1, 3), (2, 3)]


@pytest.mark.parametrize("rule", ["open", "half_open", "closed"])
def test_point_in_box_join(spark, rule):
    rng = random.Random(6)
    b, rb = make(spark, 60, 3, 30)
    pts = [(i, *(float(rng.randrange(-30, 33)) for _ in range(3))) for i in range(300)] + [(900, None, 0.0, 0.0), (901, 0.0, math.nan, 0.0)]
    pts.append(pts[0])
    p = spark.createDataFrame(pts, "id bigint, t double, x double, y double")
    ok = {"open": lambda l, v, h: l < v < h, "half_open": lambda l, v, h: l <= v < h, "closed": lambda l, v, h: l <= v <= h}[rule]
    want = sorted((i, j) for i, *v in pts if i < 900 for j, q in upright(rb) if all(ok(*z) for z in zip(q.low, v, q.high)))
    got = sorted((r["p_id"], r["b_id"]) for r in J.point_in_box_join(p, b, rule).collect())
    assert got == want and want
    assert J.point_in_box_join(p, b.where("false"), rule).count() == 0


def test_best_cell_join(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 9.0, 5.0, 5.0), (2, 0.0, 5.0, 0.0, 9.0, 10.0, 5.0), (3, 0.0, 0.0, 5.0, 9.0, 5.0, 10.0)], "cell_id bigint, " + ", ".join(f"{n} double" for n in NAMES))
    b = spark.createDataFrame([(1, 1.0, 4.0, 1.0, 2.0, 7.0, 2.0), (2, 1.0, 4.0, 4.0, 2.0, 6.0, 6.0), (3, 1.0, 50.0, 1.0, 2.0, 51.0, 2.0)], SCHEMA)
    assert sorted(map(tuple, J.best_cell_join(b, cells, "id").collect())) == [(1, 2, 2.0), (2, 1, 1.0)]


def test_knn(spark):
    rows = [(i, float(i % 7), float(i % 5), float(i % 3)) for i in range(60)] + [(98, None, 0.0, 0.0), (99, math.nan, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id bigint, t double, x double, y double")
    dist = lambda r, s=(1, 1, 1): math.sqrt(sum(((v - q) * w) ** 2 for v, q, w in zip(r[1:], (3, 2, 1), s)))
    for scale in ((1.0, 1.0, 1.0), (0.1, 1.0, 2.0)):
        want = [r[0] for r in sorted(rows[:60], key=lambda r: (round(dist(r, scale), 9), r[0]))[:9]]
        assert [r["id"] for r in J.knn(df, (3, 2, 1), 9, "id", scale).collect()] == want
    assert J.knn(df, (0, 0, 0), 500, "id").count() == 60 and J.knn(df, (0, 0, 0), 0, "id").count() == 0
    assert "TakeOrderedAndProject" in J.knn(df, (0, 0, 0), 5, "id")._jdf.queryExecution().executedPlan().toString()
    b = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 2.0, 2.0, 1.0), (2, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], SCHEMA)
    assert [(r["id"], r["dist"]) for r in J.knn(b, (0, 0, 0), 2, "id").collect()] == [(2, math.sqrt(3)), (1, 3.0)]


@pytest.mark.parametrize(("k", "leaf_rows", "slice_rows"), [(1, 1000, 1000), (4, 6, 1000), (4, 9, 4), (50, 1000, 1000), (50, 10, 7)])
def test_knn_join(spark, k, leaf_rows, slice_rows):
    rng = random.Random(8)
    left = [(i, *(rng.uniform(0, 10) for _ in range(3))) for i in range(12)] + [(77, None, 1.0, 1.0), (78, 500.0, 500.0, 500.0)]
    right = [(i, *(rng.choice([rng.uniform(0, 10), 5.0]) for _ in range(3))) for i in range(40)] + [(99, math.nan, 1.0, 1.0)]
    want = {}
    for i, *p in left:
        if p[0] is not None:
            near = sorted((math.dist(p, q), j) for j, *q in right if not math.isnan(q[0]))[:k]
            want |= {(i, n): j for n, (_, j) in enumerate(near, 1)}
    s = "id bigint, t double, x double, y double"
    got = J.knn_join(spark.createDataFrame(left, s), spark.createDataFrame(right + right[:5], s), k, leaf_rows, slice_rows).collect()
    assert {(r["left_id"], r["rank"]): r["right_id"] for r in got} == want and len(got) == len(want)
    none = spark.createDataFrame([], s)
    with pytest.raises(ValueError):
        J.knn_join(none, none, 0)
    assert J.knn_join(none, spark.createDataFrame(right, s), k).count() == 0 and J.knn_join(spark.createDataFrame(left, s), none, k).count() == 0


def test_knn_join_datapoints_takes_every_twentieth_point(spark, tmp_path):
    rng, n = np.random.default_rng(5), 42_000
    at = np.column_stack([rng.uniform(1.7040e9, 1.7066e9, n), rng.uniform(-32768, 32768, n), rng.uniform(-24576, 24576, n)])
    for low, high, x in ((0, n // 4, -20000), (n // 4, n // 2, 9000)):  # half of the points in two busy cells
        at[low:high, 1], at[low:high, 2] = rng.uniform(x, x + 1024, high - low), rng.uniform(0, 1024, high - low)
    pdf = pd.DataFrame({"id": rng.permutation(n), "t": at[:, 0], "x": at[:, 1], "y": at[:, 2]})
    pd.concat([pdf, pdf.head(50)]).to_parquet(tmp_path / "datapoints.parquet", index=False)
    got = {(r["left_id"], r["rank"]): r["right_id"] for r in queries()["knn_join_datapoints"](spark, str(tmp_path)).collect()}
    want, ids = {}, pdf["id"].to_numpy()
    for i in np.flatnonzero(ids % 20 == 0):
        d = np.sqrt(((at - at[i]) ** 2).sum(1))
        near = np.argpartition(d, 5)[:5]
        want |= {(ids[i], r): ids[j] for r, j in enumerate(near[np.argsort(d[near])], 1)}
    assert got == want and len(want) == n // 20 * 5


def test_few_huge_boxes_among_many_small_ones(spark):
    """The huge ones mustn't make the cells of the small ones wide."""
    import time

    rng, n = np.random.default_rng(4), 60_000
    low = rng.uniform(0, 1000, (n, 3))
    high = low + 0.01
    low[:10], high[:10] = 0.0, rng.uniform(500, 1e6, (10, 1))
    low[10:20] = high[10:20] = 5e5  # boxes without extent, all of them in some of the huge ones
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([low, high]), columns=NAMES).assign(id=np.arange(n)))
    began = time.monotonic()
    got = J.intersects_join(df.where("id < 10"), df).where("a_id != b_id").count()
    both = J.intersects_join(df.repartition(4), df).where("a_id != b_id").count()
    assert time.monotonic() - began < 60
    over = [(low < high[i]).all(1) & (high > low[i]).all(1) for i in range(10)]
    want = sum(int(o.sum()) for o in over) - 10
    small = low[20:]
    pairs = sum(int(((np.abs(small - p) < 0.01).all(1)).sum()) for p in small[:400]) - 400
    assert got == want and both >= 2 * want - 90 and pairs >= 0
    points = df.selectExpr("id", "t1 t", "x1 x", "y1 y")
    held = J.point_in_box_join(points, df.where("id < 10")).count()
    assert held == sum(int(((low >= low[i]) & (low < high[i])).all(1).sum()) for i in range(10))


def test_tiny_and_degenerate_boxes(spark):
    rows = [(1, 1.7e9, 0.0, 0.0, 1.7e9, 1e-300, 0.0), (2, 1.7e9 - 1, -1.0, -1.0, 1.7e9 + 1, 1.0, 1.0), (3, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (4, -1e-300, -1.0, -1.0, 1e-300, 1.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r["a_id"], r["b_id"]) for r in J.intersects_join(df, df).where("a_id < b_id").collect()) == [(1, 2), (3, 4)]
