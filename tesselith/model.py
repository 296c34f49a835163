"""Record types: points, data points and boxes in (t, x, y), as flat columns."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields
from enum import Enum

from pyspark.sql import types as T


class Boundary(str, Enum):
    """Which faces of a box belong to it: none, the low ones, or all."""

    OPEN = "open"
    HALF_OPEN = "half_open"
    CLOSED = "closed"


class Kind(str, Enum):
    """What a range query returns."""

    GET = "get"
    DISTINCT = "distinct"
    DISTRIBUTION = "distribution"
    AVERAGE = "average"
    COUNT = "count"


LOWS, HIGHS = ("t1", "x1", "y1"), ("t2", "x2", "y2")
AXES = ("t", "x", "y")


@dataclass(frozen=True)
class Box:
    """A literal box; low and high corner."""

    t1: float
    x1: float
    y1: float
    t2: float
    x2: float
    y2: float

    @classmethod
    def parse(cls, text: str) -> Box:
        parts = [float(p) for p in text.split(",")]
        if len(parts) != 6:
            raise ValueError(f"a box has six numbers: {text!r}")
        return cls(*parts)

    @property
    def low(self) -> tuple[float, float, float]:
        return self.t1, self.x1, self.y1

    @property
    def high(self) -> tuple[float, float, float]:
        return self.t2, self.x2, self.y2

    @property
    def extents(self) -> tuple[float, float, float]:
        return tuple(h - l for l, h in zip(self.low, self.high))

    def valid(self) -> bool:
        return not any(map(math.isnan, self.low + self.high))

    def overlaps(self, other: Box) -> bool:
        """Open overlap: touching isn't enough."""
        return all(a < d and c < b for a, b, c, d in zip(self.low, self.high, other.low, other.high))

    def touches(self, other: Box) -> bool:
        """Closed overlap."""
        return all(a <= d and c <= b for a, b, c, d in zip(self.low, self.high, other.low, other.high))

    def contains(self, other: Box) -> bool:
        return all(a <= c and d <= b for a, b, c, d in zip(self.low, self.high, other.low, other.high))

    def intersection(self, other: Box) -> Box | None:
        if not self.overlaps(other):
            return None
        return Box(*map(max, self.low, other.low), *map(min, self.high, other.high))

    def union(self, other: Box) -> Box:
        return Box(*map(min, self.low, other.low), *map(max, self.high, other.high))

    def __str__(self) -> str:
        return ",".join(repr(getattr(self, f.name)) for f in fields(self))


def _schema(**columns: str) -> T.StructType:
    kinds = {"double": T.DoubleType(), "bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in columns.items()])


_BOX = dict.fromkeys(LOWS + HIGHS, "double")
POINT = _schema(t="double", x="double", y="double")
DATAPOINT = _schema(t="double", x="double", y="double", id="bigint", data_value="int")
BOX = _schema(**_BOX)
CELL = _schema(cell_id="bigint", **_BOX)
PARTITION = _schema(**_BOX, filename="string")
SHAPES = {"point": POINT, "datapoint": DATAPOINT, "box": BOX, "cell": CELL, "partition": PARTITION}


def shape_schema(name: str) -> T.StructType:
    """Schema by name; prefixes do, and the old names rect and prism are boxes."""
    name = name.lower()
    for alias in ("rect", "prism"):
        if name.startswith(alias):
            name = "box"
    for known in ("datapoint", "point", "box", "cell", "partition"):
        if name.startswith(known):
            return SHAPES[known]
    raise ValueError(f"unknown shape {name!r}")


def infer_shape(line: str) -> T.StructType:
    """Schema of a text line by its number of columns: 3 point, 5 data point, 6 box, 7 cell or partition."""
    parts = line.split(",")
    try:
        return {3: POINT, 5: DATAPOINT, 6: BOX}[len(parts)]
    except KeyError:
        if len(parts) == 7:
            return CELL if parts[0].lstrip("-").isdigit() and _number(parts[6]) else PARTITION
        raise ValueError(f"no shape has {len(parts)} columns") from None


def _number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True
