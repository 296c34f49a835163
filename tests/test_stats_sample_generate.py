import math

import pytest
from pyspark.sql import functions as F

from tesselith.model import Box
from tesselith.operators import generate as G
from tesselith.operators import sample as S
from tesselith.operators import stats

AREA = Box(0, -10, 100, 50, 10, 300)


def test_mbr(spark):
    df = spark.createDataFrame([(1, 1.0, None, math.nan), (1, 5.0, -2.0, 3.0), (2, None, 7.0, 1.0)], "k int, t double, x double, y double")
    assert tuple(stats.mbr(df).first()) == (1.0, -2.0, 1.0, 5.0, 7.0, 3.0)
    assert {r["k"]: r["x2"] for r in stats.mbr(df, "k").collect()} == {1: -2.0, 2: 7.0}
    assert stats.mbr_box(df.where("false")) is None and stats.mbr_box(df.where("k = 2")) is None
    b = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0, 9.0, 1.0), (-1.0, 0.0, 0.0, 0.5, 1.0, 1.0)], "t1 double, x1 double, y1 double, t2 double, x2 double, y2 double")
    assert stats.mbr_box(b) == Box(-1, 0, 0, 1, 9, 1)


def test_counts(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "cast(id as double) t", "0.5D x", "0.5D y")
    assert stats.record_count(df).first()[0] == 1000 and stats.record_count(df, Box(10, 0, 0, 20, 1, 1)).first()[0] == 9
    assert stats.approx_count(df, 30) == 1000
    counted, seen = stats.with_counters(df)
    counted.write.format("noop").mode("overwrite").save()
    assert seen.get["n_rows"] == 1000
    path = str(tmp_path / "lines")
    spark.range(40_000).selectExpr("case when id % 10 = 0 then '' else repeat('ab', int(id % 20)) || 'x' end value").coalesce(2).write.text(path)
    exact = stats.line_count(spark, path).first()[0]
    assert exact == 36_000 and abs(stats.approx_line_count(spark, path, 0.05)[0] - 36_000) < 1_000
    assert stats.line_count(spark, path).columns == ["cnt"]


def test_lines_of_unlike_and_compressed_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stats, "PIECE_BYTES", (2048, 64 << 20))
    unlike, zipped = str(tmp_path / "unlike"), str(tmp_path / "zipped")
    parts = [spark.range(60_000).selectExpr("repeat('long', 10) value"), spark.range(90_000).selectExpr("if(id % 3 = 0, '', 'x') value")]
    for i, df in enumerate(parts):
        df.coalesce(1).write.text(f"{unlike}/{i}")
    spark.read.option("recursiveFileLookup", True).text(unlike).repartition(6).write.text(zipped, compression="gzip")
    counted = []
    count = stats._counter
    monkeypatch.setattr(stats, "_counter", lambda df: (lambda c, n: (lambda p: counted.extend(p) or c(p), n))(*count(df)))
    for path in (f"{unlike}/*", zipped):
        counted.clear()
        value, low, high = stats.approx_line_count(spark, path)
        assert low <= 120_000 <= high and abs(value - 120_000) < 1200 and high - low <= 0.0101 * high
        assert len(set(counted)) == len(counted) < 600
    assert value == low == high  # six files that can't be split are counted whole
    empty = tmp_path / "none"
    empty.mkdir()
    assert stats.approx_line_count(spark, str(empty)) == (0, 0, 0)


def test_estimate():
    numbers = iter([3.0, 5.0] * 100_000)
    low, high = stats.estimate(lambda n: [next(numbers) for _ in range(n)], lambda m: 100 / m, lambda lo, hi: hi - lo < 0.01 * hi)
    assert low <= 25 <= high and high - low < 0.25
    assert stats.estimate(lambda n: [2.0], lambda m: m, lambda lo, hi: False) == (2.0, 2.0)
    with pytest.raises(ValueError):
        stats.estimate(lambda n: [], lambda m: m, lambda lo, hi: True)


def rows(spark, n=3000):
    return spark.range(n).selectExpr("id", "repeat('x', int(id % 50)) v")


def test_samples(spark):
    df = rows(spark)
    assert 200 < S.sample_ratio(df, 0.1, 1).count() < 400 and S.sample_ratio(df, 0.5, 1, 77).count() == 77
    for n in (0, 1, 500, 3000, 9000):
        got = [r["id"] for r in S.sample_count(df, n, 5, ["id"]).collect()]
        assert len(got) == len(set(got)) == min(n, 3000)
    a, b = ({r["id"] for r in S.sample_count(df, 300, s).collect()} for s in (1, 2))
    assert a != b and len(a & b) < 100
    same = spark.range(100).selectExpr("1 as a", "cast(null as string) b")
    assert S.sample_count(same, 30, 1).count() == 30 and S.sample_count(same.where("false"), 30, 1).count() == 0
    hot = spark.range(1000).selectExpr("if(id % 3 = 0, -1L, id) id", "cast(null as string) v")
    S._PORTION, before = 50, S._PORTION
    try:
        for n in (100, 400, 900):
            got = [r["id"] for r in S.sample_count(hot, n, 3, ["id"]).collect()]
            others = [i for i in got if i >= 0]
            assert len(got) == n and len(others) == len(set(others)) and got.count(-1) <= 334
        assert sum(len(r["v"]) + 1 for r in S.sample_bytes(hot.selectExpr("id", "'abc' v"), 1001, 3, F.col("v"), ["id"]).collect()) == 1000
    finally:
        S._PORTION = before
    with pytest.raises(ValueError):
        S.sample_ratio(df, 1.5, 1)
    with pytest.raises(ValueError):
        S.sample_count(df, -1, 1)


def test_every_row_is_as_likely(spark):
    df, hits = rows(spark, 200), [0] * 200
    for seed in range(16):
        for r in S.sample_count(df, 50, seed, ["id"]).collect():
            hits[r["id"]] += 1
    assert sum((h - 4) ** 2 / 3 for h in hits) / 200 < 1.4


def test_sample_bytes(spark):
    df = rows(spark)
    text = F.col("v")
    for size in (0, 3, 1000, 20_000, 10**9):
        got = S.sample_bytes(df, size, 3, text, ["id"]).collect()
        used = sum(len(r["v"]) + 1 for r in got)
        assert used <= size and (len(got) == 3000 or used + 51 > size)
    assert S.sample_bytes(spark.createDataFrame([(None,), ("ab",)], "v string"), 4, 1).count() == 2


def test_shuffle_and_tail(spark):
    df = rows(spark)
    got = [r["id"] for r in S.shuffle_rows(df, 4).collect()]
    assert sorted(got) == list(range(3000)) and got != sorted(got)
    assert [r["id"] for r in S.tail(df, 3, "id").collect()] == [2999, 2998, 2997]
    assert S.tail(df, 0, "id").count() == 0 and S.tail(df.where("false"), 5, "id").count() == 0


@pytest.mark.parametrize("kind", list(G.Distribution))
def test_points_stay_in_the_box(spark, kind):
    df = G.generate(spark, 4000, AREA, kind, "datapoint", 3)
    r = df.selectExpr("count(*) n", *[f"{f}({a}) {a}_{f}" for a in "txy" for f in ("min", "max")], "min(id)", "max(id)", "min(data_value)", "max(data_value)", "corr(x, y) c").first()
    assert r["n"] == 4000
    for a, l, h in zip("txy", AREA.low, AREA.high):
        assert l <= r[f"{a}_min"] < r[f"{a}_max"] <= h
    assert 0 <= r["min(id)"] and r["max(id)"] < 10**6 and r["min(data_value)"] == 0 and r["max(data_value)"] == 99
    # y has a deviation of rho * sd(x) and sigma * sqrt(1 - rho^2) around it
    sign = {G.Distribution.CORRELATED: 1, G.Distribution.ANTI_CORRELATED: -1}.get(kind)
    assert sign is None and abs(r["c"]) < 0.1 or sign is not None and sign * r["c"] > 0.95


def test_moments(spark):
    g = G.generate(spark, 20_000, Box(-1, -1, -1, 1, 1, 1), "gaus", seed=5).selectExpr("stddev(t) t", "stddev(x) x", "avg(y) y").first()
    assert abs(g["t"] - 0.2) < 0.01 and abs(g["x"] - 0.2) < 0.01 and abs(g["y"]) < 0.01
    c = G.generate(spark, 20_000, Box(-1, -1, -1, 1, 1, 1), "circle", seed=5).selectExpr("avg(sqrt(x*x + y*y)) r", "stddev(t) t").first()
    assert abs(c["r"] - 0.8) < 0.01 and abs(c["t"] - 1 / math.sqrt(3)) < 0.02
    one, two = (G.generate(spark, 100, AREA, seed=s).collect() for s in (1, 1))
    assert one == two and one != G.generate(spark, 100, AREA, seed=2).collect()


def test_boxes_and_bytes(spark):
    b = G.generate(spark, 1000, AREA, shape="box", seed=1, rect_size=5)
    assert b.where("x1 < -10 or x2 > 10 or t2 > 50 or x2 - x1 > 6 or t2 < t1 or (x2 < 10 and x2 - x1 < 2)").count() == 0
    df = G.generate_bytes(spark, 100_000, AREA, shape="datapoint", seed=1)
    size = df.select(F.sum(F.length(F.concat_ws(",", *df.columns)) + 1)).first()[0]
    assert abs(size - 100_000) < 3_000
    assert G.distribution("anti") is G.Distribution.ANTI_CORRELATED and G.distribution("cor") is G.Distribution.CORRELATED
    with pytest.raises(ValueError):
        G.distribution("poisson")
    with pytest.raises(ValueError):
        G.generate(spark, 1, AREA, shape="tree")


def test_approx_count_ends_early_only_within_the_error(spark):
    uneven = spark.range(0, 64, numPartitions=64).selectExpr("explode(sequence(1, if(id % 8 = 0, 5000, 1))) v")
    assert stats.approx_count_range(uneven, 0) == (8 * 5000 + 56,) * 3 and stats.approx_count(uneven, 0) == 8 * 5000 + 56
    value, low, high = stats.approx_count_range(spark.range(0, 64_000, numPartitions=64).selectExpr("explode(sequence(1, 1 + id % 3)) v"), 0)
    assert low <= 127_999 <= high and low <= value <= high < low * 1.011
    assert stats.approx_count_range(spark.range(0, 9, numPartitions=64).where("id = 8"), 0) == (1, 1, 1)
    assert stats.approx_count_range(spark.range(0), 0) == (0, 0, 0)


def test_ranked_order_ranks_every_row(spark):
    rows = [(i, float(i * 7919 % 13), float(i % 5), None if i % 50 == 0 else float(-i % 3)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id bigint, t double, x double, y double").repartition(5)
    got = S.ranked_order(df, [F.col(c) for c in ("t", "x", "y", "id")]).orderBy("rank").collect()
    want = sorted(rows, key=lambda r: (r[1], r[2], r[3] is not None, r[3] or 0.0, r[0]))
    assert [tuple(r)[:4] for r in got] == want and [r["rank"] for r in got] == list(range(1, 1501))
