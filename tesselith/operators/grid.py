"""Uniform grids: dimensions, cells, and cells of points and boxes as arithmetic on columns; cells of equal numbers of rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.model import AXES, Box

#: Rows of a sample that cells are cut on: for each cell, at least and at most in all.
SAMPLED, LEAST_SAMPLED, MOST_SAMPLED = 200, 20_000, 2_000_000


def num_partitions(size: int, block: int, overhead: float = 0.2) -> int:
    """Blocks needed for ``size`` bytes and what an index adds."""
    if block <= 0:
        raise ValueError("block must be above 0")
    return max(1, math.ceil(size * (1 + overhead) / block))


@dataclass(frozen=True)
class Grid:
    """layers x columns x rows equal cells of a box, numbered from 1: layer fastest, then column, then row."""

    box: Box
    layers: int
    columns: int
    rows: int

    def __post_init__(self) -> None:
        if min(self.counts) < 1:
            raise ValueError("a grid has at least one cell each way")

    @classmethod
    def fit(cls, box: Box, n: int, scale: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Grid:
        """A grid of at least n cells: the dimension with the widest cells, in units of scale, is split further until
        there are enough. Of equally wide ones, y goes before x and x before t."""
        counts = [1, 1, 1]
        extents = [e * s for e, s in zip(box.extents, scale)]
        while math.prod(counts) < n:
            widths = [e / c for e, c in zip(extents, counts)]
            widest = max(range(3), key=lambda i: (widths[i], i))
            counts[widest] += 1
        return cls(box, *counts)

    @property
    def counts(self) -> tuple[int, int, int]:
        return self.layers, self.columns, self.rows

    @property
    def size(self) -> int:
        return math.prod(self.counts)

    @property
    def widths(self) -> tuple[float, float, float]:
        return tuple(e / c for e, c in zip(self.box.extents, self.counts))

    def cell_id(self, layer: int, column: int, row: int) -> int:
        return (row * self.columns + column) * self.layers + layer + 1

    def place(self, cell_id: int) -> tuple[int, int, int]:
        """(layer, column, row) of a cell."""
        if not 1 <= cell_id <= self.size:
            raise ValueError(f"no cell {cell_id}")
        rest, layer = divmod(cell_id - 1, self.layers)
        row, column = divmod(rest, self.columns)
        return layer, column, row

    def cell(self, cell_id: int) -> Box:
        at = self.place(cell_id)
        low = [l + i * w for l, i, w in zip(self.box.low, at, self.widths)]
        high = [h if i + 1 == c else l + (i + 1) * w for l, h, i, c, w in zip(self.box.low, self.box.high, at, self.counts, self.widths)]
        return Box(*low, *high)

    def cell_range(self, box: Box) -> tuple[tuple[int, int, int], tuple[int, int, int]]:
        """First and last (layer, column, row) that a box reaches, kept within the grid."""
        first, last = [], []
        for l, w, c, a, b in zip(self.box.low, self.widths, self.counts, box.low, box.high):
            lo = min(c - 1, max(0, math.floor((a - l) / w))) if w > 0 else 0
            hi = min(c - 1, max(lo, math.ceil((b - l) / w) - 1)) if w > 0 else 0
            first.append(lo)
            last.append(hi)
        return tuple(first), tuple(last)

    def cells(self, spark: SparkSession) -> DataFrame:
        """(cell_id, t1..y2) of all cells, made on the executors."""
        layer = F.pmod(F.col("id"), F.lit(self.layers))
        column = F.pmod(F.floor(F.col("id") / self.layers), F.lit(self.columns))
        row = F.floor(F.col("id") / (self.layers * self.columns))
        out = [(F.col("id") + 1).alias("cell_id")]
        for end in (0, 1):
            for a, at, l, h, w, c in zip(AXES, (layer, column, row), self.box.low, self.box.high, self.widths, self.counts):
                edge = F.lit(l) + (at + end) * F.lit(w)
                out.append((F.when(at + 1 == c, F.lit(h)).otherwise(edge) if end else edge).alias(f"{a}{end + 1}"))
        return spark.range(self.size).select(*out)

    def _index(self, axis: int, v: Column) -> Column:
        width, count, low = self.widths[axis], self.counts[axis], self.box.low[axis]
        if not width > 0 or count == 1:
            return F.when(v.isNotNull(), F.lit(0).cast("bigint"))
        return F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(count - 1).cast("bigint"), F.floor((v - F.lit(low)) / F.lit(width))))

    def _last(self, axis: int, first: Column, v: Column) -> Column:
        width, count, low = self.widths[axis], self.counts[axis], self.box.low[axis]
        if not width > 0 or count == 1:
            return F.lit(0).cast("bigint")
        return F.greatest(first, F.least(F.lit(count - 1).cast("bigint"), F.ceil((v - F.lit(low)) / F.lit(width)) - 1))

    def _id(self, layer: Column, column: Column, row: Column) -> Column:
        return ((row * self.columns + column) * self.layers + layer + 1).cast("bigint")

    def cell_of(self, t: Column, x: Column, y: Column) -> Column:
        """Cell of a point; points on or beyond the outer faces are in the outer cells, null or NaN ones in none."""
        known = F.lit(True)
        for v in (t, x, y):
            known &= v.isNotNull() & ~F.isnan(v)
        return F.when(known, self._id(*[self._index(i, v) for i, v in enumerate((t, x, y))]))

    def _ranges(self, prefix: str) -> list[tuple[Column, Column]]:
        firsts = [self._index(i, F.col(f"{prefix}{a}1")) for i, a in enumerate(AXES)]
        return [(f, self._last(i, f, F.col(f"{prefix}{a}2"))) for i, (a, f) in enumerate(zip(AXES, firsts))]

    def cells_of_box(self, prefix: str = "") -> Column:
        """Array of the cells that a box overlaps openly, the cell of its low corner always among them."""
        lay, col, row = [F.sequence(f, l) for f, l in self._ranges(prefix)]
        known = F.lit(True)
        for a in AXES:
            for i in "12":
                c = F.col(f"{prefix}{a}{i}")
                known &= c.isNotNull() & ~F.isnan(c)
        ids = F.flatten(F.transform(row, lambda r: F.flatten(F.transform(col, lambda c: F.transform(lay, lambda l: self._id(l, c, r))))))
        return F.when(known, ids)

    def best_cell_of_box(self, prefix: str = "") -> Column:
        """The cell with the largest common volume with a box, per dimension, as cells are a product; of equal ones the first."""
        at = []
        for i, (a, (first, last)) in enumerate(zip(AXES, self._ranges(prefix))):
            width, low = self.widths[i], self.box.low[i]
            if not width > 0 or self.counts[i] == 1:
                at.append(first)
                continue
            lo, hi = F.col(f"{prefix}{a}1"), F.col(f"{prefix}{a}2")
            common = lambda k: F.least(hi, F.lit(low) + (k + 1) * F.lit(width)) - F.greatest(lo, F.lit(low) + k * F.lit(width))  # noqa: B023, E731
            best = F.when(common(last) > common(first), last).otherwise(first)
            full = F.when(common(first + 1) > common(first), first + 1).otherwise(first)
            at.append(F.when(last - first >= 2, full).otherwise(best))
        return F.when(self.cells_of_box(prefix).isNotNull(), self._id(*at))


def assign_cells(df: DataFrame, grid: Grid, replicate: bool = False) -> DataFrame:
    """df with cell_id: of points, their one cell; of boxes, the best one or, with replicate, a row for each cell they
    overlap. Rows with a null or NaN coordinate have cell_id null and stay one row."""
    if "t1" not in df.columns:
        return df.withColumn("cell_id", grid.cell_of(*[F.col(a) for a in AXES]))
    if not replicate:
        return df.withColumn("cell_id", grid.best_cell_of_box())
    return df.withColumn("cell_id", F.explode_outer(grid.cells_of_box()))


def reference_cell(grid: Grid, query: Box, cell: str = "cell_id") -> Column:
    """Whether a replicated box's row is the one to report for a query: the row in the cell of the low corner of the
    common part. Of the copies of a box exactly one is."""
    corner = [F.greatest(F.lit(q), F.col(f"{a}1")) for q, a in zip(query.low, AXES)]
    return F.col(cell) == grid.cell_of(*corner)


def grid_histogram(df: DataFrame, grid: Grid) -> DataFrame:
    """(cell_id, cnt) of the cells that hold rows."""
    return assign_cells(df, grid, replicate=True).where("cell_id is not null").groupBy("cell_id").agg(F.count(F.lit(1)).alias("cnt"))


@dataclass(frozen=True)
class Slabs:
    """Cells that split a sample into nearly equal numbers: slabs of t, those of x within each, those of y within each of
    these; the outer faces are infinite. t, x, y: the cuts of each axis, of all slabs one after another, with the place where
    those of a slab begin (first) and the number of the first slab of the next axis, or cell, within it."""

    cuts: tuple[np.ndarray, np.ndarray, np.ndarray]
    first: tuple[np.ndarray, np.ndarray, np.ndarray]

    @classmethod
    def fit(cls, sample: np.ndarray, counts: Sequence[int]) -> Slabs:
        """sample: rows t, x, y. Equal cuts are one, so there may be fewer cells than counts asks for."""
        if min(counts) < 1:
            raise ValueError("counts are at least 1")
        groups, cuts, firsts = [sample], [], []
        for axis, n in enumerate(counts):
            own, parts = [], []
            for rows in groups:
                v = np.sort(rows[:, axis])
                places = np.unique(v[[len(v) * i // n for i in range(1, n)]]) if len(v) else v
                places = places[places > v[0]] if len(v) else places
                own.append(places)
                slab = np.searchsorted(places, rows[:, axis], "right")
                parts += [rows[slab == i] for i in range(len(places) + 1)]
            cuts.append(np.concatenate(own) if own else np.empty(0))
            firsts.append(np.concatenate([[0], np.cumsum([len(o) for o in own])]).astype("int64"))
            groups = parts
        return cls(tuple(cuts), tuple(firsts))

    @property
    def size(self) -> int:
        return int(self.first[2][-1]) + len(self.first[2]) - 1

    def _slab(self, axis: int, outer: np.ndarray, v: np.ndarray, side: str) -> np.ndarray:
        """Number within its outer slab of the slab of each value: how many cuts are not above it, or with side left, below it."""
        lo, hi = self.first[axis][outer].copy(), self.first[axis][outer + 1].copy()
        start, cuts = lo.copy(), np.append(self.cuts[axis], np.inf)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            past = (cuts[mid] <= v) if side == "right" else (cuts[mid] < v)
            lo, hi = np.where(open_ & past, mid + 1, lo), np.where(open_ & ~past, mid, hi)
        return lo - start

    def cell_of(self, p: np.ndarray) -> np.ndarray:
        """Cells, from 1 on, of locations t, x, y: low <= v < high."""
        slab = np.zeros(len(p), "int64")
        for axis in range(3):
            slab = self._slab(axis, slab, p[:, axis], "right") + self.first[axis][slab] + slab
        return slab + 1

    def cells_of(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for the cells that boxes overlap openly; one without extent in a dimension is in the slab that holds it there."""
        row, slab = np.arange(len(low)), np.zeros(len(low), "int64")
        for axis in range(3):
            a = self._slab(axis, slab, low[row, axis], "right")
            n = np.maximum(self._slab(axis, slab, high[row, axis], "left"), a) - a + 1
            begin = np.repeat(self.first[axis][slab] + slab + a, n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, slab = np.repeat(row, n), begin + step
        return row, slab + 1

    def table(self, spark: SparkSession) -> DataFrame:
        """(cell_id, t1..y2)."""
        rows: list[tuple[list[float], list[float], int]] = [([], [], 0)]
        for axis in range(3):
            inner = []
            for low, high, slab in rows:
                own = self.cuts[axis][self.first[axis][slab] : self.first[axis][slab + 1]].tolist()
                begin = int(self.first[axis][slab]) + slab
                inner += [([*low, l], [*high, h], begin + i) for i, (l, h) in enumerate(zip([-math.inf, *own], [*own, math.inf]))]
            rows = inner
        return spark.createDataFrame([(slab + 1, *low, *high) for low, high, slab in rows], "cell_id bigint, t1 double, x1 double, y1 double, t2 double, x2 double, y2 double")


def centres_of(df: DataFrame) -> DataFrame:
    """(t, x, y) of points, or of the middles of boxes, that have all coordinates."""
    pts = df.select(*AXES) if "t" in df.columns else df.select(*[((F.col(f"{a}1") + F.col(f"{a}2")) / 2).alias(a) for a in AXES])
    return pts.where(" and ".join(f"{a} is not null and not isnan({a})" for a in AXES))


def slabs_of(df: DataFrame, counts: Sequence[int], seed: int = 1) -> Slabs:
    """Slabs of nearly equal numbers of rows, cut on a sample of SAMPLED rows for each cell, at most MOST_SAMPLED."""
    n = df.count()
    wanted = min(MOST_SAMPLED, max(LEAST_SAMPLED, SAMPLED * math.prod(counts)))
    some = df if wanted >= n else df.sample(False, wanted / n, seed)
    return Slabs.fit(centres_of(some).toPandas().to_numpy(float).reshape(-1, 3), counts)


def str_cells(df: DataFrame, counts: Sequence[int]) -> DataFrame:
    """(cell_id, t1..y2): cells that split points, or centres of boxes, into nearly equal numbers, by slabs of t, then x,
    then y. Outer faces are infinite, so everything is in a cell, low <= v < high."""
    return slabs_of(df, counts).table(df.sparkSession)
