"""Per-key results where a few keys hold most rows.

Every result is a fold of algebraic aggregates, so each task combines its own rows in a hash table that Spark spills as
mergeable states, and only one compact state per key and task is shuffled: a key with a third of all rows costs the
reducer no more than any other key does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _known(c: str) -> Column:
    """The value, with NaN as null."""
    return F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`"))


def key_stats(
    df: DataFrame,
    key: str,
    coords: Sequence[str] = ("t", "x", "y"),
    value: str = "data_value",
    edges: Sequence[float] = tuple(range(0, 101, 10)),
) -> DataFrame:
    """One row per key, null included: counts, bounds, moments and the distribution of a value.

    n_rows; n_located (rows with no coordinate null or NaN); {c}_min and {c}_max over the coordinates that are
    neither null nor NaN; n_values, value_sum, value_sumsq, value_min, value_max over values neither null nor NaN; and
    n_bin_00, n_bin_01, ...: values below the first edge, in [edge, next edge), ..., and from the last edge on.
    Repeated rows count as often as they occur. An empty df gives no rows; other columns play no part.
    """
    if list(edges) != sorted(set(edges)) or not edges:
        raise ValueError("edges must rise")
    k = F.col(f"`{key}`")
    v = _known(value)
    located = F.lit(True)
    for c in coords:
        located &= _known(c).isNotNull()
    bounds = [f(_known(c)).alias(f"{c}_{n}") for c in coords for n, f in (("min", F.min), ("max", F.max))]
    lows, highs = [None, *edges], [*edges, None]
    bins = []
    for i, (low, high) in enumerate(zip(lows, highs)):
        inside = F.lit(True) if low is None else v >= F.lit(low)
        if high is not None:
            inside &= v < F.lit(high)
        bins.append(F.count_if(v.isNotNull() & inside).alias(f"n_bin_{i:02d}"))
    wide = v.cast("bigint") if dict(df.dtypes)[value] in ("tinyint", "smallint", "int", "bigint") else v
    return df.groupBy(k.alias(key)).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(located).alias("n_located"),
        *bounds,
        F.count(v).alias("n_values"),
        F.sum(wide).alias("value_sum"),
        F.sum(wide * wide).alias("value_sumsq"),
        F.min(v).alias("value_min"),
        F.max(v).alias("value_max"),
        *bins,
    )


def heavy_keys(df: DataFrame, key: str, share: tuple[int, int] = (1, 50)) -> DataFrame:
    """(key, n_rows) of the non-null keys that carry at least share[0]/share[1] of all rows, null keys counted in the total.

    The total is a scalar subquery over the row count, so no per-key state moves for it.
    """
    num, den = share
    counts = df.groupBy(F.col(f"`{key}`").alias(key)).agg(F.count(F.lit(1)).alias("n_rows"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.where(F.col(f"`{key}`").isNotNull() & (F.col("n_rows") * den >= total * num))
