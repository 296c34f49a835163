"""Sources mixed to target shares of the total size, by capped water-filling.

The total is shared out in proportion to the targets; a source that would have to be repeated more than its limit is
clamped at it, and what it can't give is shared out among the others in proportion, until no source is beyond its limit.
A source's records are then all taken as often as its repetitions are whole, and a seeded hash picks records for
the fraction, in the order of the hash until the fraction's tokens are reached. The place where that is, is found by
two rounds of interval sums and a short ordered run, so no source is ever sorted.
"""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselith.session import SMALL_ROWS

#: Sources that targets may name (200,000); they are worked on at the driver and broadcast, a few dozen bytes each.
MAX_SOURCES = SMALL_ROWS


def water_fill(available: Mapping[str, int], share: Mapping[str, float], repeats: Mapping[str, int], total: float) -> dict[str, float]:
    """Size given to each source of share; less than total in all only if every source is at its limit."""
    out = {s: 0.0 for s in share}
    limit = {s: float(available.get(s, 0)) * repeats[s] for s, w in share.items() if w > 0}
    # Those that reach their limit first, in the order of the level at which they do.
    order = sorted(limit, key=lambda s: Fraction(limit[s]) / Fraction(share[s]))
    weights = [*accumulate(share[s] for s in reversed(order))][::-1]  # of a source and all after it
    left = float(total)
    for i, s in enumerate(order):
        if left * (share[s] / weights[i]) < limit[s]:
            return out | {r: min(limit[r], left * (share[r] / weights[i])) for r in order[i:]}
        out[s] = limit[s]
        left -= limit[s]
    return out


def read_targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """source -> (share, limit). Rows without a source, and shares that are null, NaN, infinite or not above 0, aim at nothing;
    of a repeated source the shares add up and the highest limit holds; a null limit is 1, one below 0 is 0."""
    rows = targets.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    out: dict[str, tuple[float, int]] = {}
    for r in rows:
        share = r["target_share"]
        if r["source"] is not None:
            w, m = out.get(r["source"], (0.0, 0))
            limit = 1 if r["max_repeats"] is None else max(0, r["max_repeats"])
            out[r["source"]] = (w + (share if share is not None and 0 < share < float("inf") else 0.0), max(m, limit))
    return out


def _cutoffs(sizes: DataFrame, want: dict[str, float]) -> dict[str, tuple[int, int | None]]:
    """For each source of want, the hash and id up to which records are taken to come nearest to the wanted size."""
    spark = sizes.sparkSession
    if not want:
        return {}
    # One row per source, of which there are at most MAX_SOURCES.
    aim = F.broadcast(spark.createDataFrame(list(want.items()), "source string, __want double"))
    rows = sizes.join(aim, "source").withColumns({"__a": F.shiftright("u", 52), "__b": F.shiftright("u", 40)})

    def crossing(parts: DataFrame, key: str, base: str) -> DataFrame:
        up_to = Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = parts.groupBy("source", "__want", base, key).agg(F.sum("n_tokens").alias("__n")).withColumn("__up", F.col(base) + F.sum("__n").over(up_to))
        return sums.where((F.col("__up") >= F.col("__want")) & (F.col("__up") - F.col("__n") < F.col("__want"))).select("source", key, (F.col("__up") - F.col("__n")).alias("__below"))

    first = crossing(rows.withColumn("__zero", F.lit(0).cast("bigint")), "__a", "__zero")
    first = spark.createDataFrame(first.collect(), "source string, __a bigint, __below bigint")
    second = crossing(rows.join(F.broadcast(first.withColumnRenamed("__below", "__base")), ["source", "__a"]), "__b", "__base")
    second = spark.createDataFrame(second.collect(), "source string, __b bigint, __below bigint")
    run = rows.join(F.broadcast(second), ["source", "__b"])  # the records of one of 16 million intervals of each source
    run = run.groupBy("source", "__want", "__below", "u", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"))  # copies are one
    order = Window.partitionBy("source").orderBy("u", F.asc_nulls_first("doc_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = run.withColumn("__mid", F.col("__below") + F.sum("n_tokens").over(order) - F.col("n_tokens") / 2)
    last = run.where(F.col("__mid") <= F.col("__want")).groupBy("source").agg(F.max(F.struct("u", "doc_id")).alias("m")).collect()
    found = {r["source"]: (r["m"]["u"], r["m"]["doc_id"]) for r in last}
    for r in second.collect():  # none of the run is taken: up to the end of the interval before
        found.setdefault(r["source"], ((r["__b"] << 40) - 1, 2**63 - 1))
    return found


def mix(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Chosen records (doc_id, source, n_tokens, repeats), and a report per source of the targets.

    sizes: source, doc_id, n_tokens and u, a hash of the id and the seed; it is read several times, so give it
    materialised. total: the size of the mixture, by default that of all records whose source has a target. Records of
    other sources, of none, or without size (a null text) aren't used; repeated rows are records of their own, but the
    fraction takes rows with equal ids together. Report: source, target_share, max_repeats, available_tokens,
    planned_tokens, used_tokens, n_records, reached_share (null if nothing is used), capped.
    """
    spark = sizes.sparkSession
    aims = read_targets(targets)
    known = spark.createDataFrame([(s,) for s in aims], "source string")
    rows = sizes.where("n_tokens is not null").join(F.broadcast(known), "source")
    available = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    plan = water_fill(available, {s: w for s, (w, _) in aims.items()}, {s: m for s, (_, m) in aims.items()}, sum(available.values()) if total is None else total)
    whole, want = {}, {}
    for s, size in plan.items():
        have, limit = available.get(s, 0), aims[s][1]
        if have == 0:
            whole[s] = min(1, limit) if aims[s][0] > 0 else 0  # records without tokens cost nothing
            continue
        whole[s] = min(limit, int(size // have))
        part = size - whole[s] * have
        if whole[s] < limit and part > 0:
            want[s] = part
    ends = _cutoffs(rows, want)
    # The least place there is, for sources without a fraction.
    table = [(s, whole[s], *ends.get(s, (-(2**63), None)), s in ends) for s in aims]
    steps = spark.createDataFrame(table, "source string, __whole int, __u bigint, __id bigint, __some boolean")
    upto = (F.col("u") < F.col("__u")) | ((F.col("u") == F.col("__u")) & (F.col("doc_id").isNull() | (F.col("doc_id") <= F.col("__id"))))
    extra = F.when(F.col("__some") & F.coalesce(upto, F.lit(False)), 1).otherwise(0)
    chosen = rows.join(F.broadcast(steps), "source").withColumn("repeats", F.col("__whole") + extra).where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"), F.count(F.lit(1)).alias("n_records"))
    head = [(s, w, m, available.get(s, 0), plan[s], plan[s] >= available.get(s, 0) * m) for s, (w, m) in aims.items()]
    report = (
        spark.createDataFrame(head, "source string, target_share double, max_repeats int, available_tokens bigint, planned_tokens double, capped boolean")
        .join(used, "source", "left")
        .withColumns({"used_tokens": F.coalesce("used_tokens", F.lit(0).cast("bigint")), "n_records": F.coalesce("n_records", F.lit(0).cast("bigint"))})
    )
    all_used = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))  # one row per source
    report = report.withColumn("reached_share", F.when(all_used > 0, F.col("used_tokens") / all_used))
    return chosen, report.select("source", "target_share", "max_repeats", "available_tokens", "planned_tokens", "used_tokens", "n_records", "reached_share", "capped")
