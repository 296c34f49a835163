"""Samples by share, by number and by bytes, shuffles and tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselith.session import cut

_LEVELS, _PORTION = (52, 40, 28), 100_000


def _key(df: DataFrame, seed: int, ids: list[str] | None) -> Column:
    """A hash of the rows' ids, or of all their columns; the same at every run."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in (ids or df.columns)])


def sample_ratio(df: DataFrame, ratio: float, seed: int, limit: int | None = None) -> DataFrame:
    """Each row with probability ratio, independently; with limit, about that many of them at most, each as likely.

    The thinning to limit takes the rows with the smallest random keys, over all tasks."""
    if not 0 <= ratio <= 1:
        raise ValueError("ratio lies in 0..1")
    rows = df.sample(False, ratio, seed)
    return rows if limit is None else sample_count(rows, limit, seed)


def _prefix(df: DataFrame, key: Column, weight: Column, total: int) -> DataFrame:
    """The rows with the least keys whose weights add up to no more than total, ties of the key by all columns.

    The end is found by sums over intervals of the key, each within the one before, so no task orders more than the
    different rows of one of 2 ** 36 intervals."""
    rows = df.withColumns({"__k": key, "__w": weight.cast("bigint")})
    below, inside = 0, rows
    for shift in _LEVELS:
        at = F.shiftright("__k", shift)
        sums = inside.groupBy(at.alias("__p")).agg(F.sum("__w").alias("__n"))
        up = F.sum("__n").over(Window.partitionBy(F.lit(1)).orderBy("__p").rowsBetween(Window.unboundedPreceding, 0))
        # At most 4096 intervals a level.
        over = sums.withColumn("__up", up + below).where(F.col("__up") > total).orderBy("__p").limit(1).collect()
        if not over:
            return df  # it all fits; that shows at the first level
        below, edge, last = over[0]["__up"] - over[0]["__n"], over[0]["__p"], shift
        inside = inside.where(at == edge)
    # Copies of a row are counted, not ordered, and what is taken of them is made again in portions.
    names = [F.col(f"`{c}`") for c in df.columns]
    order = Window.partitionBy(F.lit(1)).orderBy("__k", *names).rowsBetween(Window.unboundedPreceding, 0)
    copies = inside.groupBy("__k", "__w", *names).agg(F.count(F.lit(1)).alias("__m"))
    size = F.col("__m") * F.col("__w")
    room = F.lit(total - below) - (F.sum(size).over(order) - size)
    taken = copies.withColumn("__t", F.least(F.col("__m"), F.greatest(F.lit(0).cast("bigint"), F.floor(room / F.col("__w"))))).where("__t > 0")
    portions = taken.withColumn("__c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__t") - 1) / _PORTION)))).repartition("__k", "__c")
    some = portions.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(_PORTION).cast("bigint"), F.col("__t") - F.col("__c") * _PORTION))))
    return rows.where(F.col("__k") < (edge << last)).select(*names).unionByName(some.select(*names))


def sample_count(df: DataFrame, n: int, seed: int, ids: list[str] | None = None) -> DataFrame:
    """n rows without replacement, or all if there are fewer, every row as likely; equal rows are rows of their own.

    The order is that of a hash of ids (of all columns if none are named), so the same rows come at every run."""
    if n < 0:
        raise ValueError("n must not be negative")
    return _prefix(df, _key(df, seed, ids), F.lit(1), n)


def sample_bytes(df: DataFrame, nbytes: int, seed: int, text: Column | None = None, ids: list[str] | None = None) -> DataFrame:
    """Rows in random order up to the last that keeps the size of their text within nbytes.

    text: what is measured, by default the row as comma-separated text; each row counts one byte more for its end. A
    null text counts as empty."""
    line = text if text is not None else F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])
    return _prefix(df, _key(df, seed, ids), F.coalesce(F.octet_length(line), F.lit(0)) + 1, nbytes)


def shuffle_rows(df: DataFrame, seed: int) -> DataFrame:
    """All rows in random order."""
    return df.orderBy(F.rand(seed))


def tail(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The last n rows by order, last one first; each task keeps n rows only."""
    if n < 0:
        raise ValueError("n must not be negative")
    return df.orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in order]).limit(n)


def ranked_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """All rows of df with their rank from 1 in the given order (nulls first): sorted within ranges, each task one of them."""
    ranges = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    up = F.sum("__n").over(Window.partitionBy(F.lit(1)).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0))
    before = ranges.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", up - F.col("__n")).drop("__n")  # a row a range
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranges.join(F.broadcast(before), "__part").withColumn("rank", F.col("__before") + within).drop("__part", "__before")
