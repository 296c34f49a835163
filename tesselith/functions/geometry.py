"""Predicates and measures of points and boxes as column expressions.

A point is the columns t, x, y and a box t1, x1, y1, t2, x2, y2, each with an optional prefix; a Box literal may stand
for a box. Comparisons are with the stored columns, so they reach the file scan. A null or NaN coordinate makes no
predicate true.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.model import AXES, Boundary, Box

Side = Box | str


def _low(side: Side) -> list[Column]:
    return [F.lit(v) for v in side.low] if isinstance(side, Box) else [F.col(f"{side}{a}1") for a in AXES]


def _high(side: Side) -> list[Column]:
    return [F.lit(v) for v in side.high] if isinstance(side, Box) else [F.col(f"{side}{a}2") for a in AXES]


def _point(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{a}") for a in AXES]


def _all(parts) -> Column:
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def within(box: Side, boundary: Boundary | str = Boundary.OPEN, point: str = "") -> Column:
    """Point in box: open low < v < high, half_open low <= v < high, closed low <= v <= high."""
    kind = Boundary(boundary)
    low = (lambda v, l: v > l) if kind is Boundary.OPEN else (lambda v, l: v >= l)
    high = (lambda v, h: v <= h) if kind is Boundary.CLOSED else (lambda v, h: v < h)
    # NaN is above everything in comparisons, so an upper bound keeps it out.
    return _all([low(v, l) & high(v, h) for v, l, h in zip(_point(point), _low(box), _high(box))])


def intersects(a: Side, b: Side) -> Column:
    """Open overlap of boxes: a.high > b.low and b.high > a.low in each dimension. NaN is nowhere."""
    parts = [(ah > bl) & (bh > al) for al, ah, bl, bh in zip(_low(a), _high(a), _low(b), _high(b))]
    known = [~F.isnan(c) for side in (a, b) if not isinstance(side, Box) for c in _high(side)]
    return _all(parts + known)


def contains(a: Side, b: Side) -> Column:
    """Box a holds box b, faces included."""
    return _all([(al <= bl) & (bh <= ah) & ~F.isnan(bl) & ~F.isnan(bh) for al, ah, bl, bh in zip(_low(a), _high(a), _low(b), _high(b))])


def intersection(a: Side, b: Side) -> Column:
    """The common box as a struct t1..y2, null if the boxes don't overlap."""
    low = [F.greatest(p, q).alias(f"{n}1") for n, p, q in zip(AXES, _low(a), _low(b))]
    high = [F.least(p, q).alias(f"{n}2") for n, p, q in zip(AXES, _high(a), _high(b))]
    return F.when(intersects(a, b), F.struct(*low, *high))


def union_box(a: Side, b: Side) -> Column:
    """The box around both, as a struct t1..y2."""
    low = [F.least(p, q).alias(f"{n}1") for n, p, q in zip(AXES, _low(a), _low(b))]
    high = [F.greatest(p, q).alias(f"{n}2") for n, p, q in zip(AXES, _high(a), _high(b))]
    return F.struct(*low, *high)


def _norm(parts: list[Column]) -> Column:
    t, x, y = parts
    return F.sqrt(t * t + x * x + y * y)


def dist_pp(a: str, b: str, scale: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Column:
    """Distance of two points, each dimension times its scale."""
    return _norm([(p - q) * F.lit(float(s)) if s != 1 else p - q for p, q, s in zip(_point(a), _point(b), scale)])


def max_dist_pb(point: str, box: Side) -> Column:
    """Distance of a point to the farthest corner of a box; the distance of a box in nearest-neighbour queries."""
    return _norm([F.greatest(v - l, h - v) for v, l, h in zip(_point(point), _low(box), _high(box))])


def min_dist_pb(point: str, box: Side, exact: bool = True) -> Column:
    """Least distance of a point to a box, 0 if inside.

    exact=False is the older rule: 0 in the half-open box; the distance to the nearest corner if the point is outside in
    all dimensions; else the least distance to a face's plane in any one dimension."""
    p, low, high = _point(point), _low(box), _high(box)
    if exact:
        return _norm([F.greatest(l - v, v - h, F.lit(0.0)) for v, l, h in zip(p, low, high)])
    gaps = [F.least(F.abs(v - l), F.abs(h - v)) for v, l, h in zip(p, low, high)]
    outside = _all([(v < l) | (v > h) for v, l, h in zip(p, low, high)])
    return F.when(within(box, Boundary.HALF_OPEN, point), F.lit(0.0)).when(outside, _norm(gaps)).otherwise(F.least(*gaps))


def min_dist_bb(a: Side, b: Side) -> Column:
    """Least distance of two boxes, 0 if they overlap or touch."""
    return _norm([F.greatest(bl - ah, al - bh, F.lit(0.0)) for al, ah, bl, bh in zip(_low(a), _high(a), _low(b), _high(b))])


def max_dist_bb(a: Side, b: Side) -> Column:
    """Diagonal of the box around both."""
    return _norm([F.greatest(ah, bh) - F.least(al, bl) for al, ah, bl, bh in zip(_low(a), _high(a), _low(b), _high(b))])


def center(box: str = "") -> list[Column]:
    """Middle of a box as columns t, x, y."""
    return [((l + h) / 2).alias(n) for n, l, h in zip(AXES, _low(box), _high(box))]


def extents(box: str = "") -> list[Column]:
    """depth, width and height."""
    return [(h - l).alias(n) for n, l, h in zip(("depth", "width", "height"), _low(box), _high(box))]


def mbr_of_point(point: str = "") -> list[Column]:
    """The box without extent at a point, as columns t1..y2."""
    p = _point(point)
    return [c.alias(f"{n}{i}") for i in (1, 2) for n, c in zip(AXES, p)]


def same_place(a: str, b: str, box: bool = False) -> Column:
    """All coordinates equal, nulls equal to nulls."""
    names = [f"{n}{i}" for i in (1, 2) for n in AXES] if box else list(AXES)
    return _all([F.col(a + n).eqNullSafe(F.col(b + n)) for n in names])


def shape_order(box: bool = False, prefix: str = "") -> list[Column]:
    """Sort order of shapes: t, x, y of points; low, then high corner of boxes."""
    return [F.col(prefix + n) for n in ([f"{n}{i}" for i in (1, 2) for n in AXES] if box else AXES)]


def to_text(columns: list[str]) -> Column:
    """A record as comma-separated text; nulls are empty."""
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def _stored_bounds(df: DataFrame, c: Column, low: float, high: float) -> Column | None:
    """A test of a timestamp or whole-number column in its own type that all values between two bounds pass, so that a file
    scan can use it; it lets at most a unit more pass."""
    kind = df.select(c.alias("c")).dtypes[0][1]
    tests = []
    if kind.startswith("timestamp"):
        for v, way, unit in ((low, -1, math.floor), (high, 1, math.ceil)):
            if abs(v) < 2e11:  # microseconds that fit
                edge = F.timestamp_micros(F.lit(unit(v * 1e6) + 2 * way)).cast(kind)
                tests.append(c >= edge if way < 0 else c <= edge)
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        most = 2 ** {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 53}[kind]
        if -most <= low < most:
            tests.append(c >= F.lit(math.floor(low)).cast(kind))
        if -most <= high < most:
            tests.append(c <= F.lit(math.ceil(high) if math.ceil(high) < most else most - 1).cast(kind))
    return _all(tests)


def as_points(df: DataFrame, t: str | Column, x: str | Column, y: str | Column, keep: dict[str, str | Column] | None = None, inside: Box | None = None) -> DataFrame:
    """Points (t, x, y, keep...) of any table; timestamps become epoch seconds.

    inside: a box of which only points are wanted; timestamps and whole numbers are then also compared in their own type,
    which a scan of files can use as it can't the tests of converted values. Points a little outside may remain: the range
    query tests them exactly."""

    def number(c: str | Column) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        kind = df.select(c.alias("c")).dtypes[0][1]
        return c.cast("timestamp").cast("double") if kind.startswith(("timestamp", "date")) else c.cast("double")

    if inside is not None and inside.valid():
        for c, low, high in zip((t, x, y), inside.low, inside.high):
            test = _stored_bounds(df, F.col(c) if isinstance(c, str) else c, low, high)
            df = df if test is None else df.where(test)
    extra = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in (keep or {}).items()]
    return df.select(number(t).alias("t"), number(x).alias("x"), number(y).alias("y"), *extra)


def register(spark: SparkSession) -> None:
    """SQL functions of a session; they are inlined, so their comparisons are pushed down."""
    spark.sql("create or replace temporary function in_open(v double, lo double, hi double) returns boolean return v > lo and v < hi")
    spark.sql("create or replace temporary function in_half_open(v double, lo double, hi double) returns boolean return v >= lo and v < hi")
    spark.sql("create or replace temporary function in_closed(v double, lo double, hi double) returns boolean return v >= lo and v <= hi")
    spark.sql("create or replace temporary function overlaps_open(lo1 double, hi1 double, lo2 double, hi2 double) returns boolean return hi1 > lo2 and hi2 > lo1")
    spark.sql("create or replace temporary function dist3(t1 double, x1 double, y1 double, t2 double, x2 double, y2 double) returns double return sqrt((t1 - t2) * (t1 - t2) + (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))")
    spark.sql("create or replace temporary function map_of_text(s string) returns map<string, string> return str_to_map(trim(both '[]' from s), ',', '#')")
