"""Random points and boxes in a bounding box."""

from __future__ import annotations

import math
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.model import Box


class Distribution(str, Enum):
    UNIFORM = "uniform"
    GAUSSIAN = "gaussian"
    CORRELATED = "correlated"
    ANTI_CORRELATED = "anti_correlated"
    CIRCLE = "circle"


# Standard deviation of the gaussian, correlation, radius and its spread, in half extents.
SIGMA, RHO, RADIUS, SPREAD = 0.2, 0.9, 0.8, 1 / 30
#: Draws per value where values outside a range are drawn again; all of them fail once in 10 ** 12 at most.
_TRIES = 12


def distribution(name: str) -> Distribution:
    """By prefix: uni, gaus, cor, anti, circle."""
    for d in Distribution:
        if len(name) >= 3 and d.value.startswith(name.lower()):
            return d
    raise ValueError(f"unknown distribution {name!r}")


def _draws(rows: DataFrame, name: str, draws: list[Column]) -> DataFrame:
    """rows with an array of draws; a column of its own, so that a test of a draw and its use are of the same draw."""
    return rows.withColumn(name, F.array(*draws))


def _first(name: str, good) -> Column:
    """The first draw that is good."""
    return F.coalesce(F.get(F.filter(name, good), 0), F.lit(0.0))


def _between(low: float, high: float, seed: int) -> Column:
    return F.rand(seed) * (high - low) + F.lit(low)


def _scaled(v: Column, low: float, high: float) -> Column:
    return v * ((high - low) / 2) + F.lit((low + high) / 2)


def generate(spark: SparkSession, n: int, box: Box, kind: Distribution | str = Distribution.UNIFORM, shape: str = "point", seed: int = 0, rect_size: int = 100) -> DataFrame:
    """n random records in box: point (t, x, y), datapoint (and id in 0..999999, data_value in 0..99) or box (t1..y2).

    Points: uniform; gaussian around the middle in all dimensions; correlated and anti-correlated in x and y, and on
    a circle in x and y, with t uniform. Boxes start uniformly, are 2 to rect_size + 1 wide and high and as long in t, and
    end at the bounding box. The same seed, n and number of partitions give the same records.
    """
    d = Distribution(kind) if isinstance(kind, Distribution) else distribution(kind)
    s = seed * 1009
    rows = spark.range(n)
    if shape == "box":
        lows = [_between(l, h, s + i) for i, (l, h) in enumerate(zip(box.low, box.high))]
        rows = rows.select("id", *[c.alias(f"{a}1") for a, c in zip("txy", lows)])
        ends = [F.least(F.lit(h), F.col(f"{a}1") + F.floor(F.rand(s + 10 + i) * max(1, rect_size)) + 2).alias(f"{a}2") for i, (a, h) in enumerate(zip("txy", box.high))]
        return rows.select("t1", "x1", "y1", *ends)
    t = _between(box.t1, box.t2, s)
    if d is Distribution.UNIFORM:
        x, y = _between(box.x1, box.x2, s + 1), _between(box.y1, box.y2, s + 2)
    elif d is Distribution.GAUSSIAN:
        for i, a in enumerate("txy"):
            rows = _draws(rows, f"__{a}", [F.randn(s + 10 * i + j) * SIGMA for j in range(2)])
        t, x, y = (_scaled(_first(f"__{a}", lambda d: F.abs(d) <= 1), l, h) for a, l, h in zip("txy", box.low, box.high))
    elif d is Distribution.CIRCLE:
        rows = rows.withColumn("__a", F.rand(s + 1) * (2 * math.pi))
        for i, a in enumerate(("__rx", "__ry"), 1):
            rows = _draws(rows, a, [F.lit(RADIUS) + F.randn(s + 10 * i + j) * SPREAD for j in range(2)])
        x, y = (_scaled(f("__a") * _first(r, lambda v: v <= 1), l, h) for f, r, l, h in ((F.cos, "__rx", box.x1, box.x2), (F.sin, "__ry", box.y1, box.y2)))
    else:
        rows = _draws(rows.withColumn("__x", F.rand(s + 1) * 2 - 1), "__g", [F.randn(s + 10 + j) * (math.sqrt(1 - RHO * RHO) * SIGMA) for j in range(_TRIES)])
        rows = rows.withColumn("__v", F.transform("__g", lambda g: F.col("__x") * RHO + g))
        v = _first("__v", lambda r: F.abs(r) <= 1)
        x = _scaled(F.col("__x"), box.x1, box.x2)
        y = _scaled(-v if d is Distribution.ANTI_CORRELATED else v, box.y1, box.y2)
    out = [t.alias("t"), x.alias("x"), y.alias("y")]
    if shape == "datapoint":
        out += [F.floor(F.rand(s + 101) * 1_000_000).cast("bigint").alias("id"), F.floor(F.rand(s + 102) * 100).cast("int").alias("data_value")]
    elif shape != "point":
        raise ValueError(f"unknown shape {shape!r}")
    return rows.select(*out)


def generate_bytes(spark: SparkSession, nbytes: int, box: Box, kind: Distribution | str = Distribution.UNIFORM, shape: str = "point", seed: int = 0, rect_size: int = 100) -> DataFrame:
    """About nbytes of text: as many records as their mean line length, measured on 1,000 of them, asks for."""
    few = generate(spark, 1000, box, kind, shape, seed, rect_size)
    mean = few.select(F.octet_length(F.concat_ws(",", *[F.col(c).cast("string") for c in few.columns])).alias("n")).agg(F.avg("n")).first()[0] + 1
    return generate(spark, max(1, round(nbytes / mean)), box, kind, shape, seed, rect_size)
