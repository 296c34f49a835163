"""Percentiles of very large columns by exact bisection, and summaries of them that merge.

The state is one value interval per group and percentile, and the rank looked for within it. A pass counts, per
interval, the rows below many midpoints at once (the counts of the parts between them), keeps the part that holds the
rank, and takes its smallest and largest value as the next interval; a percentile is resolved when they are equal. The
first pass uses midpoints in proportion to the value (2 ** (1 / STEPS) apart), later ones evenly spaced ones, so no
pass can miss. Rows are never sorted or moved: each pass shuffles counts only, whatever share of the rows a group has.

The counts of the first pass are also the mergeable summary: those of days, files or partitions add up, and from the
sum a percentile is known to lie between two values at most 2 ** (1 / STEPS) - 1 (0.55 %) apart, of exact rank.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselith.session import SMALL_ROWS, cut

#: Midpoints of the first pass for each doubling of the value; parts of an interval in later passes.
STEPS, FAN = 128, 4096
#: Binary exponents of doubles lie within this.
_FAR = 1100


def _clean(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    v = F.col(f"`{value}`").cast("double")
    return df.select(F.col(f"`{group}`").alias("__g"), *[F.col(f"`{b}`") for b in by], (v + 0.0).alias("__v")).where(v.isNotNull() & ~F.isnan(v))


def _part(v: Column) -> Column:
    size = F.floor(F.least(F.log2(F.abs(v)), F.lit(float(_FAR))) * STEPS) + (_FAR + 1) * STEPS
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("bigint")


def summaries(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mergeable states: (group, by..., part, n, low, high), one row per part of the value axis in use.

    Null and NaN values are left out, infinite ones are values; a null group is a group; every row counts, also
    repeated ones. There are at most 2 * 2201 * STEPS + 1 parts per group, in practice as many as 128 a doubling.
    """
    rows = _clean(df, group, value, by).withColumn("part", _part(F.col("__v")))
    grouped = rows.groupBy(F.col("__g").alias(group), *[F.col(f"`{b}`") for b in by], "part")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))


def merge(states: DataFrame, group: str, by: Sequence[str] = ()) -> DataFrame:
    """The summary of all rows whose summaries are given, of each group or of each group and by."""
    keys = [F.col(f"`{c}`") for c in (group, *by, "part")]
    return states.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def bounds(states: DataFrame, group: str, permille: Sequence[int]) -> DataFrame:
    """(group, permille, n, rank, low, high, skipped): of merged states, the bounds of the value with rank
    ceil(permille / 1000 * n), 1 at least, and how many rows lie below low."""
    if not all(0 <= p <= 1000 for p in permille):
        raise ValueError("permille lies in 0..1000")
    g = F.col(f"`{group}`")
    of_group = Window.partitionBy(g)
    up_to = of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = states.withColumns({"__up": F.sum("n").over(up_to), "__n": F.sum("n").over(of_group)})
    wanted = ranked.withColumn("permille", F.explode(F.array(*[F.lit(int(p)) for p in sorted(set(permille))])))
    rank = F.greatest(F.lit(1).cast("bigint"), F.expr("(permille * __n + 999) div 1000"))
    below = F.col("__up") - F.col("n")
    return (
        wanted.withColumn("rank", rank)
        .where((below < F.col("rank")) & (F.col("rank") <= F.col("__up")))
        .select(g.alias(group), "permille", F.col("__n").alias("n"), "rank", "low", "high", below.alias("skipped"))
    )


def percentiles(df: DataFrame, group: str, value: str, permille: Sequence[int], fan: int = FAN, broadcast_rows: int = SMALL_ROWS) -> DataFrame:
    """(group, permille, n, value): the exact value of rank ceil(permille / 1000 * n) among a group's n values.

    Nulls, NaN, ties and repeated rows are as in summaries; a group without values has no row, an empty df no rows;
    other columns play no part. After the first pass at most ceil(46 / log2(fan)) passes follow, usually one or two.
    Each pass checkpoints the state, which has a row per group and percentile; broadcast_rows intervals are broadcast
    at once, more in several passes.
    """
    if fan < 2:
        raise ValueError("fan must be 2 at least")
    rows = _clean(df, group, value)
    first = bounds(summaries(rows, "__g", "__v"), "__g", permille)
    state = cut(first.select(F.col("__g").alias("g"), "permille", "n", (F.col("rank") - F.col("skipped")).alias("rank"), "low", "high"))
    while True:
        unsolved = state.where("low < high")
        intervals = unsolved.select("g", "low", "high").distinct()
        size = intervals.count()
        if size == 0:
            return state.select(F.col("g").alias(group), "permille", "n", F.col("low").alias("value"))
        same = F.col("__g").eqNullSafe(F.col("g")) & (F.col("__v") >= F.col("low")) & (F.col("__v") <= F.col("high"))
        # As many map-side passes as the intervals fill broadcasts; rows never move. Hashed slices are of about equal size.
        slices = -(-size // max(1, broadcast_rows))
        if slices > 1:
            slices += 1 + slices // 4
            intervals = cut(intervals.withColumn("__s", F.pmod(F.xxhash64("g", "low", "high"), F.lit(slices))))
        parts = [intervals] if slices == 1 else [intervals.where(F.col("__s") == i).drop("__s") for i in range(slices)]
        inside = reduce(DataFrame.unionByName, [rows.join(F.broadcast(p), same) for p in parts])
        place = F.floor((F.col("__v") - F.col("low")) / (F.col("high") - F.col("low")) * fan)
        counts = (
            inside.withColumn("part", F.least(place, F.lit(fan - 1).cast("bigint")))
            .groupBy("g", "low", "high", "part")
            .agg(F.count(F.lit(1)).alias("m"), F.min("__v").alias("l"), F.max("__v").alias("h"))
        )
        up_to = Window.partitionBy("g", "low", "high").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("up", F.sum("m").over(up_to)).select(F.col("g").alias("cg"), F.col("low").alias("cl"), F.col("high").alias("ch"), "m", "l", "h", "up")
        match = F.col("g").eqNullSafe(F.col("cg")) & (F.col("low") == F.col("cl")) & (F.col("high") == F.col("ch"))
        narrowed = (
            unsolved.join(counts, match & (F.col("up") - F.col("m") < F.col("rank")) & (F.col("rank") <= F.col("up")))
            .select("g", "permille", "n", (F.col("rank") - F.col("up") + F.col("m")).alias("rank"), F.col("l").alias("low"), F.col("h").alias("high"))
        )
        state = cut(state.where("not low < high").unionByName(narrowed))
