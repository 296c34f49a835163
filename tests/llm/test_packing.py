import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesselith.llm import packing as P
from tesselith.llm import tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=120), st.integers(1, 30))
def test_pack_sizes_is_a_packing(sizes, groups):
    to = P.pack_sizes(np.array(sizes, dtype=int), 100, groups)
    assert (to >= 0).all() and len(to) == len(sizes)
    if len(sizes):
        assert np.bincount(to, weights=sizes).max() <= 100


def best(sizes, capacity):
    """Fewest containers, by trying everything."""
    sizes = sorted(sizes, reverse=True)
    found = [len(sizes)]

    def go(i, bins):
        if len(bins) >= found[0]:
            return
        if i == len(sizes):
            found[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity and bins[j] not in bins[:j]:
                go(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return found[0]


def test_near_the_optimum():
    rng = np.random.default_rng(2)
    for _ in range(25):
        sizes = rng.integers(5, 70, 10)
        assert P.pack_sizes(sizes, 100).max() + 1 <= best(sizes.tolist(), 100) + 1
    perfect = np.concatenate([[a, b, 1000 - a - b] for a, b in zip(rng.integers(300, 400, 400), rng.integers(250, 350, 400))])
    used = P.pack_sizes(rng.permutation(perfect), 1000).max() + 1
    assert used <= 400 * 1.06
    texts = np.minimum(4096, rng.lognormal(6, 1.2, 5000).astype(int))
    assert P.pack_sizes(texts, 4096).max() + 1 <= np.ceil(texts.sum() / 4096) * 1.01 + 1


def test_configurations_stay_within_demand():
    size, demand = np.array([60, 45, 30, 20]), np.array([10, 7, 30, 11])
    total = np.zeros(4, int)
    for pattern, n in P.configurations(size, demand.astype(float), 100):
        assert pattern @ size <= 100 and n > 0
        total += pattern * n
    assert (total <= demand).all() and total.sum() > 20
    assert P._knapsack(np.array([3.0, 2.0]), np.array([6, 4]), 10, 3).tolist() == [1, 1]


def test_pack(spark):
    docs = [(i, n) for i, n in enumerate([0, 0, 5, 100, 101, 250, 300, 99, 1, 50, 50, 33])] + [(50, None), (None, 7), (None, 7), (3, 100), (3, 100)]
    sizes = spark.createDataFrame(docs, "doc_id bigint, n_tokens bigint").selectExpr("*", "1 as shard", "'a' as container_kind")
    kinds = spark.createDataFrame([("s", 100), ("m", 1000), ("zero", 0), ("null", None)], "container_kind string, capacity_tokens int")
    for shards in (1, 3):
        rows = P.pack(sizes, kinds, shards).collect()
        for kind, cap in (("s", 100), ("m", 1000)):
            own = [r for r in rows if r["container_kind"] == kind]
            used = {}
            for r in own:
                used[r["container_id"]] = used.get(r["container_id"], 0) + r["n_tokens"]
                assert r["token_start"] == r["piece_no"] * cap
            assert max(used.values()) <= cap
            got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece_no"], r["n_tokens"]) for r in own)
            want = []
            for i, n in docs:
                if n is not None:
                    want += [(-1 if i is None else i, k, min(cap, n - k * cap)) for k in range(max(1, -(-n // cap)))]
            assert got == sorted(want)
        assert {r["container_kind"] for r in rows} == {"s", "m"}
    fill = {r["container_kind"]: r for r in P.fill_report(P.pack(sizes, kinds, 1), kinds).collect()}
    assert fill["m"]["n_tokens"] == sum(n for _, n in docs if n) and 0 < fill["m"]["fill"] <= 1
    assert P.pack(sizes.where("false"), kinds, 1).count() == 0 and P.pack(sizes, kinds.where("false"), 1).count() == 0


def test_texts_of_containers(spark):
    docs = spark.createDataFrame([(1, "ein Wort über alles — naïve 日本語のテキスト " * 40), (2, "short"), (3, ""), (4, None)], "doc_id bigint, text string")
    sized = docs.select("doc_id", tokens.token_count(F.col("text")).alias("n_tokens"))
    kinds = spark.createDataFrame([("a", 7), ("b", 64), ("b", 64), ("c", 0), (None, 5)], "container_kind string, capacity_tokens int")
    packed = P.pack(sized, kinds, 2)
    rows = P.texts_of(packed, docs.withColumn("container_kind", F.lit("x"))).collect()
    for kind in "ab":
        for doc, text in ((1, docs.first()["text"]), (2, "short"), (3, "")):
            own = sorted((r["piece_no"], r["text"]) for r in rows if r["doc_id"] == doc and r["container_kind"] == kind)
            assert [n for n, _ in own] == list(range(len(own))) and "".join(t for _, t in own) == text
    assert {r["container_kind"] for r in rows} == {"a", "b"} and P.pack(sized, kinds.where("container_kind = 'c'"), 2).count() == 0
