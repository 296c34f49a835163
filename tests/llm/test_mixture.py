import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesselith.llm import mixture as M


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.floats(0, 1), st.integers(0, 4)), min_size=1, max_size=8), st.integers(0, 2000))
def test_water_fill(sources, total):
    have, share, cap = ({i: s[k] for i, s in enumerate(sources)} for k in range(3))
    got = M.water_fill(have, share, cap, total)
    limit = {i: have[i] * cap[i] for i in have}
    assert all(-1e-9 <= got[i] <= limit[i] + 1e-6 for i in have)
    room = sum(limit[i] for i in have if share[i] > 0)
    assert abs(sum(got.values()) - min(total, room)) < 1e-6 * max(1, total)
    free = [i for i in have if share[i] > 1e-6 and got[i] < limit[i] - 1e-6]
    if len(free) > 1:  # below the limit, sizes are in proportion, and nobody at the limit had less than that
        level = got[free[0]] / share[free[0]]
        assert all(abs(got[i] / share[i] - level) < 1e-4 * max(1, level) for i in free)
        assert all(got[i] <= share[i] * level + 1e-4 * max(1, level) for i in have if share[i] > 0)


def sized(spark, seed=1):
    df = spark.range(4000).selectExpr(
        "id as doc_id", "case when id % 10 < 6 then 'big' when id % 10 = 6 then 'mid' when id % 100 = 7 then 'small' when id % 10 = 8 then null else 'other' end source",
        "case when id % 97 = 0 then null when id % 89 = 0 then 0 else 1 + pmod(hash(id), 300) end n_tokens")
    return df.withColumn("n_tokens", F.col("n_tokens").cast("bigint")).withColumn("u", F.xxhash64(F.lit(seed), F.col("doc_id")))


TARGETS = [("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.2, 2), ("gone", 0.1, 5), (None, 0.3, 1)]
SCHEMA = "source string, target_share double, max_repeats int"


def test_shares_and_repeats(spark):
    df, targets = sized(spark), spark.createDataFrame(TARGETS, SCHEMA)
    chosen, report = M.mix(df, targets)
    rows, by = chosen.collect(), {r["source"]: r for r in report.collect()}
    assert set(by) == {"big", "mid", "small", "gone"} and {r["source"] for r in rows} == {"big", "mid", "small"}
    assert len({r["doc_id"] for r in rows}) == len(rows)
    cap = {s: m for s, _, m in TARGETS}
    assert all(1 <= r["repeats"] <= cap[r["source"]] for r in rows)
    for s, r in by.items():
        used = sum(x["n_tokens"] * x["repeats"] for x in rows if x["source"] == s)
        assert used == r["used_tokens"] and abs(used - r["planned_tokens"]) <= 300
        assert max((x["repeats"] for x in rows if x["source"] == s), default=0) - min((x["repeats"] for x in rows if x["source"] == s), default=0) <= 1
    assert by["small"]["capped"] and by["small"]["used_tokens"] == 2 * by["small"]["available_tokens"]
    assert by["gone"]["used_tokens"] == 0 and by["gone"]["n_records"] == 0
    assert abs(by["big"]["used_tokens"] / by["mid"]["used_tokens"] - 5 / 3) < 0.01
    assert abs(sum(r["reached_share"] for r in by.values()) - 1) < 1e-9


def test_fraction_is_taken_in_the_order_of_the_hash(spark):
    df, targets = sized(spark), spark.createDataFrame([("big", 1.0, 4)], SCHEMA)
    rows = df.where("source = 'big' and n_tokens is not null").collect()
    have = sum(r["n_tokens"] for r in rows)
    for total in (0.0, 1.0, have * 0.37, float(have), have * 2.6, have * 9.0):
        chosen, report = M.mix(df, targets, total)
        got = {r["doc_id"]: r["repeats"] for r in chosen.collect()}
        plan = min(total, 4.0 * have)
        whole, left = int(plan // have), plan % have if plan < 4 * have else 0.0
        want, used = {}, 0
        for r in sorted(rows, key=lambda r: (r["u"], r["doc_id"])):
            more = left > 0 and used + r["n_tokens"] / 2 <= left
            used += r["n_tokens"]
            if whole + more:
                want[r["doc_id"]] = whole + more
        assert got == want
    assert report.first()["capped"]


def test_copies_hold_a_third(spark):
    df = spark.range(900).selectExpr("if(id % 3 = 0, -1L, id) doc_id", "'a' source", "cast(1 + id % 7 as bigint) n_tokens").withColumn("u", F.xxhash64("doc_id"))
    chosen, report = M.mix(df, spark.createDataFrame([("a", 1.0, 1)], SCHEMA), 2000.0)
    rows = chosen.collect()
    copies = sum(r["doc_id"] == -1 for r in rows)
    assert copies in (0, 300) and report.first()["used_tokens"] == sum(r["n_tokens"] for r in rows)


def test_seed_matters_and_empty(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], SCHEMA)
    a, b = ({r["doc_id"] for r in M.mix(sized(spark, s), targets, 20_000.0)[0].collect()} for s in (1, 2))
    assert a != b and a and b
    none = sized(spark).where("false")
    chosen, report = M.mix(none, targets)
    assert chosen.count() == 0 and report.first()["reached_share"] is None
    chosen, report = M.mix(sized(spark), targets.where("false"))
    assert chosen.count() == 0 and report.count() == 0


def test_targets(spark):
    rows = [("a", 0.2, 1), ("a", 0.1, 3), ("b", None, None), ("c", float("nan"), -2), ("d", -1.0, 1), (None, 1.0, 1)]
    got = M.read_targets(spark.createDataFrame(rows, SCHEMA))
    assert got["a"] == (pytest.approx(0.3), 3) and got["b"] == (0.0, 1) and got["c"] == (0.0, 0) and got["d"] == (0.0, 1) and None not in got
