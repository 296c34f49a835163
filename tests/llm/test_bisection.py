import math
import random

import pytest

from tesselith.llm import bisection as B

PM = [0, 1, 250, 500, 900, 999, 1000]


def rank(n, pm):
    return max(1, (pm * n + 999) // 1000)


def exact(rows, pm=PM):
    by = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            by.setdefault(g, []).append(v)
    return {(g, p): (len(vs), sorted(vs)[rank(len(vs), p) - 1]) for g, vs in by.items() for p in pm}


def data():
    rng = random.Random(4)
    rows = [("a", rng.gauss(0, 1)) for _ in range(3000)] + [("b", math.exp(rng.uniform(-700, 700)) * rng.choice([-1, 1])) for _ in range(800)]
    rows += [("c", 5.0)] * 500 + [("c", 5.000000000000001)] * 2 + [("d", 7.0)]
    rows += [(None, float(i)) for i in range(100)] + [("e", None), ("e", math.nan), ("f", math.inf), ("f", -math.inf), ("f", -0.0), ("f", 0.0), ("f", 5e-324), ("f", 1e-323), ("f", 1.7e308)]
    return rows


@pytest.mark.parametrize(("fan", "bound"), [(4096, 1000), (2, 1000), (64, 3)])
def test_exact(spark, fan, bound):
    rows = data()[:: 1 if fan > 2 else 7]
    df = spark.createDataFrame(rows, "query_field string, field_value double").selectExpr("*", "1 as g", "2 as low", "3 as part")
    got = {(r["query_field"], r["permille"]): (r["n"], r["value"]) for r in B.percentiles(df, "query_field", "field_value", PM, fan, bound).collect()}
    assert got == exact(rows)


def test_empty_and_arguments(spark):
    df = spark.createDataFrame([("a", None)], "query_field string, field_value double")
    assert B.percentiles(df, "query_field", "field_value", PM).count() == 0
    assert B.percentiles(df.where("false"), "query_field", "field_value", PM).count() == 0
    with pytest.raises(ValueError):
        B.percentiles(df, "query_field", "field_value", [1001]).count()
    with pytest.raises(ValueError):
        B.percentiles(df, "query_field", "field_value", [1], fan=1)


def test_days_merge_and_the_bound_holds(spark):
    rows = [(g, v, i % 5) for i, (g, v) in enumerate(data())]
    df = spark.createDataFrame(rows, "query_field string, field_value double, day int")
    days = [B.summaries(df.where(f"day = {d}"), "query_field", "field_value") for d in range(5)]
    both = days[0]
    for d in days[1:]:
        both = both.unionByName(d)
    by_day = B.merge(B.summaries(df, "query_field", "field_value", ["day"]), "query_field")
    want = exact([r[:2] for r in rows])
    for merged in (B.merge(both, "query_field"), by_day):
        got = B.bounds(merged, "query_field", PM).collect()
        assert len(got) == len(want)
        for r in got:
            n, v = want[r["query_field"], r["permille"]]
            assert r["n"] == n and r["low"] <= v <= r["high"]
            assert r["low"] == r["high"] or abs(r["high"] - r["low"]) <= (2 ** (1 / B.STEPS) - 1) * abs(v) * 1.0001 or abs(v) < 1e-300


def test_rows_are_not_moved(spark):
    df = spark.createDataFrame(data(), "query_field string, field_value double")
    plan = B.summaries(df, "query_field", "field_value")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2
