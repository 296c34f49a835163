import math

import pytest

from tesselith.operators import hot_keys as H

ROWS = [
    (1, 1.0, 2.0, 3.0, 5), (1, 1.0, 2.0, 3.0, 5), (1, None, 9.0, 9.0, None), (1, math.nan, -1.0, 0.0, 100),
    (2, None, None, None, None), (None, 4.0, 4.0, 4.0, -1), (None, 4.0, 4.0, 4.0, 2147483647),
]
SCHEMA = "cell_id bigint, t double, x double, y double, data_value int"


def test_key_stats(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 as n_rows", "'a' as t_min")
    got = {r["cell_id"]: r.asDict() for r in H.key_stats(df, "cell_id").collect()}
    one, two, none = got[1], got[2], got[None]
    assert (one["n_rows"], one["n_located"], one["t_min"], one["t_max"], one["x_min"], one["x_max"]) == (4, 2, 1.0, 1.0, -1.0, 9.0)
    assert (one["n_values"], one["value_sum"], one["value_sumsq"], one["value_max"]) == (3, 110, 10050, 100)
    assert (one["n_bin_01"], one["n_bin_11"], one["n_bin_00"]) == (2, 1, 0)
    assert two["n_rows"] == 1 and two["t_min"] is None and two["value_sum"] is None and two["n_values"] == 0
    assert none["value_sumsq"] == 2147483647**2 + 1 and none["n_bin_00"] == 1 and none["n_bin_11"] == 1
    assert H.key_stats(df.where("false"), "cell_id").count() == 0
    with pytest.raises(ValueError):
        H.key_stats(df, "cell_id", edges=[3, 1])


def test_heavy_keys(spark):
    df = spark.range(1000).selectExpr("case when id < 20 then 7L when id < 39 then 8L when id < 400 then null else 100 + id end cell_id")
    assert [(r["cell_id"], r["n_rows"]) for r in H.heavy_keys(df, "cell_id").collect()] == [(7, 20)]
    assert H.heavy_keys(df.where("false"), "cell_id").count() == 0
    assert H.heavy_keys(df.where("cell_id is null"), "cell_id").count() == 0


def test_states_are_combined_before_the_shuffle(spark):
    df = spark.range(100_000).selectExpr("if(id % 3 = 0, 1L, id % 50) cell_id", "1D t", "1D x", "1D y", "1 data_value")
    plan = H.key_stats(df, "cell_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1
    assert "NestedLoop" not in H.heavy_keys(df, "cell_id")._jdf.queryExecution().executedPlan().toString()
