import math

import numpy as np
import pytest

from tesselith.llm import reservoir as R


def test_entering_and_split_follow_their_laws(monkeypatch):
    rng = np.random.default_rng(0)
    for huge in (10**9, 1):  # numpy's draws, and the ones beyond its range
        monkeypatch.setattr(R, "_HUGE", huge)
        for batch, before, size in ((300, 700, 100), (5, 995, 990), (995, 5, 990), (1, 0, 1), (0, 9, 4)):
            x = [R.entering(rng, batch, before, size) for _ in range(2000)]
            p = batch / (batch + before)
            var = size * p * (1 - p) * (batch + before - size) / max(1, batch + before - 1)
            assert abs(np.mean(x) - size * p) <= 4 * math.sqrt(var / 2000) and abs(np.var(x) - var) <= 0.2 * var + 1e-9
            assert min(x) >= max(0, size - before) and max(x) <= min(batch, size)
        s = R.split(rng, np.array([10, 0, 30, 5]), 20)
        assert s.sum() == 20 and s[1] == 0 and (s <= [10, 0, 30, 5]).all()


def test_a_sample_of_billions_is_planned():
    k, caps = 2 * 10**9, R.capacities(2 * 10**9)
    assert caps.sum() == k and caps.max() <= R.SLOTS
    held = np.zeros(len(caps), dtype="int64")
    seen = 0
    for size in (10**9, 3 * 10**9, 10**12, 7, 0):
        step = R.make_step(size, k, 3, caps, seen, held)
        assert (step.evict <= held).all() and step.insert.sum() == step.enter <= size
        held, seen = held + step.insert - step.evict, seen + size
        assert (held <= caps).all() and held.sum() == min(k, seen)


@pytest.mark.parametrize("k", [1, 7, 100, 1000])
def test_steps_keep_the_sample_full(k):
    caps = R.capacities(k, 30)
    assert caps.sum() == k and caps.max() <= 30
    held, seen = np.zeros(len(caps), dtype="int64"), 0
    for n in [3, 0, 50, 1, 400, 20, 300]:
        step = R.make_step(n, k, 5, caps, seen, held)
        assert (step.evict <= held).all() and step.insert.sum() == step.enter <= n
        held, seen = held + step.insert - step.evict, seen + n
        assert (held <= caps).all() and held.sum() == min(k, seen)


def points(spark, n=2000):
    return spark.range(n).selectExpr("id as rec_id", "if(id % 50 = 0, null, cast(id as double)) t", "cast(id % 3 as double) x", "if(id % 90 = 1, null, timestamp_seconds(id * if(id < 700, 1, 2))) arrived_at", "1 as slot", "2 as __u")


def draw(df, k, seed, slots=40, columns=("rec_id", "t", "x"), every=1500):
    return R.reservoir_sample(df, k, "arrived_at", columns, every, seed, slots)


def test_every_record_is_as_likely(spark):
    df, k, runs = points(spark, 400), 100, 8
    hits = np.zeros(400)
    for seed in range(runs):
        ids = [r["rec_id"] for r in draw(df, k, seed, every=250).collect()]
        assert len(ids) == len(set(ids)) == k
        hits[ids] += 1
    p = k / 400
    z = (hits.reshape(10, 40).sum(1) - 40 * runs * p) / math.sqrt(40 * runs * p * (1 - p))
    assert (np.abs(z) < 4).all()
    assert ((hits - runs * p) ** 2 / (runs * p * (1 - p))).mean() < 1.4


def test_sizes_nulls_and_repeatability(spark):
    df = points(spark)
    assert draw(df, 5000, 1).count() == 2000  # fewer records than slots
    assert draw(df, 0, 1).count() == 0 and draw(df.where("false"), 10, 1).count() == 0
    one, two = draw(df, 300, 9), draw(df, 300, 9)
    assert sorted(r["rec_id"] for r in one.collect()) == sorted(r["rec_id"] for r in two.collect())
    rows = draw(df, 1990, 3).collect()
    assert any(r["t"] is None for r in rows) and any(r["rec_id"] % 90 == 1 for r in rows)
    slots = [r["slot"] for r in one.collect()]
    assert len(set(slots)) == 300 and len({s // 40 for s in slots}) == 8 and max(slots) < 320
    with pytest.raises(ValueError):
        draw(df, -1, 1)


def test_arrivals_hold_every_row_once(spark):
    df = points(spark)
    parts = [{r["rec_id"] for r in b.collect()} for b in R.arrivals(df, "arrived_at", 500.0)]
    assert len(parts) == 8 and sum(map(len, parts)) == 2000 == len(set().union(*parts)) and {1, 91, 1891} <= parts[0]
    assert len(R.arrivals(df.where("arrived_at is null"), "arrived_at", 500.0)) == 1


def test_stream_of_batches(spark, tmp_path):
    res = R.Reservoir(spark, 120, str(tmp_path / "r"), seed=3, slots=50)
    with pytest.raises(ValueError):
        res.sample()
    df = points(spark, 1000).select("rec_id", "t", "x")
    for n, (a, b) in enumerate([(0, 50), (50, 400), (400, 400), (400, 700), (700, 703), (703, 1000)]):
        res.update(df.where(f"rec_id >= {a} and rec_id < {b}"), n)
        res.update(df, n)  # a batch that comes again is ignored
        ids = [r["rec_id"] for r in res.sample().collect()]
        assert len(set(ids)) == len(ids) == min(120, b) and max(ids) < b
    assert res.state()["seen"] == 1000
    assert abs(sum(i >= 400 for i in ids) - 72) < 25
    names = sorted(p.name for p in (tmp_path / "r").iterdir() if not p.name.startswith("."))
    assert sum(n.startswith("state-") for n in names) == 2 and not any(n.startswith("tmp-") for n in names)


def test_log_is_written_anew_and_a_crash_leaves_the_last_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "LOG_SAMPLES", 1)
    res = R.Reservoir(spark, 30, str(tmp_path / "r"), seed=4, slots=8)
    for n in range(4):
        res.update(spark.range(n * 40, n * 40 + 40), n)
        assert res.state()["rows"] <= 60 and res.sample().count() == 30
    assert len(res.state()["log"]) == 1
    before = sorted(r["id"] for r in res.sample().collect())
    monkeypatch.setattr(R.Reservoir, "_keep", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        res.update(spark.range(1000, 5000), 4)
    assert sorted(r["id"] for r in res.sample().collect()) == before and res.state()["batch"] == 3
    monkeypatch.undo()
    res.update(spark.range(1000, 5000), 4)
    assert res.sample().where("id >= 1000").count() > 20


def test_from_a_stream(spark, tmp_path):
    points(spark, 600).select("rec_id", "t").repartition(3).write.parquet(str(tmp_path / "in"))
    res = R.Reservoir(spark, 50, str(tmp_path / "r"), slots=20)
    stream = spark.readStream.schema("rec_id bigint, t double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(res.update).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert res.state()["seen"] == 600 and res.sample().select("rec_id").distinct().count() == 50


def test_copies_are_drawn_one_by_one(spark):
    # a third of the rows have the id -1, and rows without id are records, too
    df = spark.range(1000).selectExpr("case when id % 3 = 2 then -1L when id % 3 = 1 then null else id end rec_id", "id row", "timestamp_seconds(id) arrived_at")
    many = []
    for seed in range(4):
        rows = draw(df, 100, seed, columns=("rec_id", "row"), every=600).collect()
        assert len({r["row"] for r in rows}) == len(rows) == 100
        many.append(sum(r["rec_id"] == -1 for r in rows))
    assert abs(np.mean(many) - 33.3) < 8 and 10 < min(many) <= max(many) < 57  # deviation of one draw: 4.5
