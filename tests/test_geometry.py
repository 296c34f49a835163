import math

import pytest
from pyspark.sql import functions as F

from tesselith.functions import geometry as G
from tesselith.model import BOX, CELL, DATAPOINT, PARTITION, POINT, Box, infer_shape, shape_schema
from tesselith.operators.range_query import range_query, range_query_many

Q = Box(0, 0, 0, 10, 10, 10)
ROWS = [(1, 5, 5, 5), (2, 0, 5, 5), (3, 5, 0, 5), (4, 5, 5, 0), (5, 10, 5, 5), (6, 5, 10, 5), (7, 5, 5, 10), (8, 0, 0, 0), (9, 10, 10, 10), (10, 11, 5, 5), (11, 5, 5, 5)]
NAMES = [f"{a}{i}" for i in "12" for a in "txy"]


def points(spark, rows=ROWS):
    return spark.createDataFrame([(i, *(None if v is None else float(v) for v in p)) for i, *p in rows], "id bigint, t double, x double, y double")


def pair(spark, a, b):
    rows = [tuple(map(float, a + b))]
    return spark.createDataFrame(rows, ", ".join(f"{p}{n} double" for p in "ab" for n in NAMES))


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(("rule", "want"), [("open", [1, 11]), ("half_open", [1, 2, 3, 4, 8, 11]), ("closed", [1, 2, 3, 4, 5, 6, 7, 8, 9, 11])])
def test_boundaries(spark, rule, want):
    odd = [(20, None, 5, 5), (21, math.nan, 5, 5), (22, 5, math.inf, 5)]
    assert ids(range_query(points(spark, ROWS + odd), Q, boundary=rule)) == want
    many = range_query_many(points(spark, ROWS + odd), [Box(11, 0, 0, 12, 9, 9), Q, Box(math.nan, 0, 0, 1, 1, 1)], boundary=rule)
    assert sorted(r["id"] for r in many.where("range_id = 1").collect()) == want


def test_kinds(spark):
    df = points(spark).withColumn("v", F.when(F.col("id") < 9, F.col("id") % 3)).withColumn("range_id", F.lit(5))
    get = lambda kind, f="v": sorted(map(tuple, range_query(df, Q, kind, f, "closed").collect()), key=str)
    assert get("distinct") == [(0,), (1,), (2,), (None,)]
    assert get("distribution") == [(0, 2), (1, 3), (2, 3), (None, 2)]
    assert get("average") == [(9 / 8,)] and get("count", None) == [(10,)]
    assert range_query(df, Box(50, 0, 0, 60, 1, 1), "average", "v").collect()[0][0] is None
    assert range_query(df.where("false"), Q, "distinct", "v").count() == 0
    for bad in ("distinct", "average"):
        with pytest.raises(ValueError):
            range_query(df, Q, bad)
    with pytest.raises(ValueError):
        range_query(df, Q, "sum", "v")
    assert range_query_many(df, [], "count").count() == 0
    assert [tuple(r) for r in range_query_many(df, [Q, Q], "count").orderBy("range_id").collect()] == [(0, 2), (1, 2)]
    assert range_query(df, Box(10, 10, 10, 0, 0, 0)).count() == 0


def test_box_pairs(spark):
    def test(a, b):
        df = pair(spark, a, b)
        r = df.select(G.intersects("a", "b").alias("i"), G.contains("a", "b").alias("c"), G.intersection("a", "b").alias("x"), G.union_box("a", "b").alias("u")).first()
        assert r["i"] == Box(*map(float, a)).overlaps(Box(*map(float, b))) and r["c"] == Box(*map(float, a)).contains(Box(*map(float, b)))
        return r["i"], r["c"], r["x"] and tuple(r["x"]), tuple(r["u"])

    five = (0, 0, 0, 5, 5, 5)
    assert test(five, (5, 0, 0, 9, 5, 5))[0] is False
    assert test(five, (4, 4, 4, 9, 9, 9)) == (True, False, (4, 4, 4, 5, 5, 5), (0, 0, 0, 9, 9, 9))
    assert test(five, (1, 1, 1, 2, 2, 2))[:2] == (True, True)
    assert test((0, 3, 3, 10, 10, 10), (1, 4, 1, 2, 5, 5))[1] is False  # below the low y face
    assert test(five, (1, 1, 1, 1, 1, 1))[0] is True and test((1, 1, 1, 1, 1, 1), (1, 1, 1, 1, 1, 1))[0] is False


def test_nan_and_null_boxes_overlap_nothing(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 2.0, 2.0, math.nan), (1.0, 1.0, 1.0, 2.0, None, 2.0), (math.nan, 1.0, 1.0, 2.0, 2.0, 2.0), (1.0, 1.0, 1.0, 2.0, 2.0, 2.0)], BOX)
    assert range_query(df, Q).count() == 1 and df.where(G.contains(Q, "")).count() == 1


def test_distances(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 6.0, 3.0)], "at double, ax double, ay double, bt double, bx double, by double")
    assert df.select(G.dist_pp("a", "b")).first()[0] == 5.0 and df.select(G.dist_pp("a", "b", (0.0, 1.0, 1.0))).first()[0] == 4.0
    d = lambda p, old=False: points(spark, [(1, *p)]).select(G.min_dist_pb("", Q, not old), G.max_dist_pb("", Q)).first()
    assert d((5, 5, 5))[0] == 0 and d((13, 5, 14))[0] == 5.0 and d((13, 14, 10))[0] == 5.0
    assert d((13, 5, 14), True)[0] == 3.0 and d((5, 5, 5), True)[0] == 0 and d((-3, -4, -12), True)[0] == 13.0 and d((10, 5, 5), True)[0] == 0
    assert d((0, 0, 0))[1] == pytest.approx(math.sqrt(300)) and d((5, 5, 5))[1] == pytest.approx(math.sqrt(75))
    two = pair(spark, (0, 0, 0, 1, 1, 1), (4, 5, 0, 6, 6, 1)).select(G.min_dist_bb("a", "b"), G.max_dist_bb("a", "b")).first()
    assert two[0] == 5.0 and two[1] == pytest.approx(math.sqrt(36 + 36 + 1))
    assert pair(spark, (0, 0, 0, 1, 1, 1), (1, 1, 1, 2, 2, 2)).select(G.min_dist_bb("a", "b")).first()[0] == 0.0


def test_conversions(spark):
    df = spark.createDataFrame([(0.0, 2.0, 4.0, 2.0, 6.0, 10.0)], BOX)
    assert tuple(df.select(*G.center()).first()) == (1.0, 4.0, 7.0) and tuple(df.select(*G.extents()).first()) == (2.0, 4.0, 6.0)
    assert tuple(points(spark, [(1, 1, 2, 3)]).select(*G.mbr_of_point()).first()) == (1, 2, 3, 1, 2, 3)
    ts = spark.sql("select timestamp_ntz '2024-01-01 00:00:07.25' ts, 3 u, null v, date '2024-01-01' d")
    assert tuple(G.as_points(ts, "ts", "u", "v", {"id": "u"}).first()) == (1704067207.25, 3.0, None, 3)
    assert G.as_points(ts, "d", "u", "v").first()[0] == 1704067200.0
    assert [r[0] for r in df.select(G.to_text(["t1", "x1"])).collect()] == ["0.0,2.0"]
    assert df.select(G.same_place("", "", True)).first()[0]


def test_sql_functions_are_pushed_down(spark, tmp_path):
    points(spark).write.parquet(str(tmp_path / "p"))
    G.register(spark)
    spark.read.parquet(str(tmp_path / "p")).createOrReplaceTempView("pts")
    df = spark.sql("select id from pts where in_open(t, 0D, 10D) and in_open(x, 0D, 10D) and in_open(y, 0D, 10D)")
    assert ids(df) == [1, 11]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(t,0.0)" in plan and "LessThan(y,10.0)" in plan
    assert spark.sql("select map_of_text('[a#1,b#2]')['b'], overlaps_open(0D, 1D, 1D, 2D), dist3(0D, 0D, 0D, 2D, 3D, 6D)").first() == ("2", False, 7.0)


def test_range_filter_reads_only_what_it_needs(spark, tmp_path):
    points(spark).withColumn("more", F.lit("x")).write.parquet(str(tmp_path / "p"))
    df = range_query(spark.read.parquet(str(tmp_path / "p")), Q, "distribution", "id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "more" not in plan.split("ReadSchema")[1] and plan.count("GreaterThan(") == 3 and plan.count("LessThan(") == 3


def test_shapes_by_name_and_by_line():
    assert shape_schema("rect") == shape_schema("Prism") == BOX and shape_schema("points") == POINT and shape_schema("datap" + "oint") == DATAPOINT
    assert infer_shape("1,2,3") == POINT and infer_shape("1,2,3,4,5") == DATAPOINT and infer_shape("1,2,3,4,5,6") == BOX
    assert infer_shape("1,2,3,4,5,6,7") == CELL and infer_shape("1,2,3,4,5,6,data_1") == PARTITION
    for bad in ("1,2", ""):
        with pytest.raises(ValueError):
            infer_shape(bad)
    with pytest.raises(ValueError):
        shape_schema("tiger")
    assert Box.parse(str(Q)) == Q
