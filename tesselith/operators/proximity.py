"""Locations in regions, and locations near other locations.

Regions are polygons in (x, y) with a time range. They are triangulated by ear clipping; the triangles go into a
bounding-volume hierarchy; locations descend it in batches and are tested exactly against the triangles they reach.
A location on an edge belongs to the triangle it would be in if moved by (+e, +e*e), e infinitely small, so exactly one
of the triangles (and one of the regions) that share an edge holds it; for an upright rectangle that is
low <= v < high. Time ranges are half-open too. The side of an edge is computed without rounding error, so this holds
for all coordinates up to 1e150. A ring that crosses itself has no triangles; region_faults tells which regions that is.

What is too large for one hierarchy is spread over the leaves of a top hierarchy (see leaves): homes are the triangles, or
the locations to be found, guests the locations that look for them and visit the leaves their surrounding box touches.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator, Sequence
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselith.operators.leaves import FELLOW, HOME, LEAF_ROWS, PAIRS, SLICE_ROWS, VISITOR, Top, Volumes, leaves_of, mixed_hash, once, placed_rows, placed_schema, sample_of, wanted_rows, work
from tesselith.session import cut

#: Triangles up to which one hierarchy is broadcast (about 100 bytes each).
BROADCAST_TRIANGLES = 200_000

TRIANGLE = "region_id bigint, ax double, ay double, bx double, by double, cx double, cy double, t1 double, t2 double"


# --- exact orientation ---------------------------------------------------------------------------------------------

#: Rounding error of the determinant relative to the sum of its products, at most.
_ERROR = 3.4e-16


def _two_diff(a, b):
    x = a - b
    v = a - x
    return x, (a - (x + v)) + (v - b)


def _two_product(a, b):
    split = lambda v: ((c := 134217729.0 * v) - (c - v))
    p = a * b
    a1, b1 = split(a), split(b)
    a2, b2 = a - a1, b - b1
    return p, a2 * b2 - (((p - a1 * b1) - a2 * b1) - a1 * b2)


def sides(ax, ay, bx, by, px, py) -> np.ndarray:
    """Row by row, 1 if p is left of the line from a to b, -1 if right, 0 if on it; without rounding error."""
    left, right = (bx - ax) * (py - ay), (by - ay) * (px - ax)
    det = left - right
    out = np.sign(det)
    unsure = (np.abs(det) <= _ERROR * (np.abs(left) + np.abs(right))) & ((left != 0) | (right != 0))
    if unsure.any():
        ax, ay, bx, by, px, py = (np.broadcast_to(v, out.shape)[unsure] for v in (ax, ay, bx, by, px, py))
        terms = []
        for sign, u, v in ((1, _two_diff(bx, ax), _two_diff(py, ay)), (-1, _two_diff(by, ay), _two_diff(px, ax))):
            terms += [sign * w for a in u for b in v for w in _two_product(a, b)]
        out[unsure] = [np.sign(math.fsum(row)) for row in np.column_stack(terms).tolist()]
    return out


def _turn(a, b, c) -> int:
    """sides for three points."""
    left, right = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    det = left - right
    if abs(det) <= _ERROR * (abs(left) + abs(right)) and (left or right):
        (a0, a1), (b0, b1), (c0, c1) = (map(Fraction, p) for p in (a, b, c))
        det = (b0 - a0) * (c1 - a1) - (b1 - a1) * (c0 - a0)
    return (det > 0) - (det < 0)


# --- triangulation -------------------------------------------------------------------------------------------------


def _crosses(pts: np.ndarray) -> bool:
    """Whether two edges of a ring cross between their ends. Edges are compared only if they overlap on one axis."""
    a, b = pts, np.roll(pts, -1, 0)
    low, high = np.minimum(a, b), np.maximum(a, b)
    spread = (high - low).sum(0) / np.maximum(high.max(0) - low.min(0), 1e-300)
    axis = int(np.argmin(spread))
    order = np.argsort(low[:, axis], kind="stable")
    a, b, low, high = a[order], b[order], low[order], high[order]
    n = np.searchsorted(low[:, axis], high[:, axis], "right") - np.arange(len(a)) - 1
    ends = np.cumsum(n)
    start = 0
    while start < len(a):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
        k = n[start:stop]
        i = np.repeat(np.arange(start, stop), k)
        j = i + 1 + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        near = (low[i, 1 - axis] <= high[j, 1 - axis]) & (low[j, 1 - axis] <= high[i, 1 - axis])
        i, j = i[near], j[near]
        across = lambda p, q, u, v: sides(*a[p].T, *b[p].T, *a[q].T) * sides(*a[p].T, *b[p].T, *b[q].T) < 0
        if (across(i, j, 0, 0) & across(j, i, 0, 0)).any():
            return True
        start = stop
    return False


def _ring(ring: Sequence[tuple[float, float]]) -> tuple[list[tuple[float, float]], str | None]:
    """Counter-clockwise vertices without repetitions in a row, and what is wrong with the ring."""
    pts: list[tuple[float, float]] = []
    for p in ring:
        if p is None or p[0] is None or p[1] is None or not (math.isfinite(p[0]) and math.isfinite(p[1])):
            return [], "incomplete vertex"
        q = (float(p[0]), float(p[1]))
        if not pts or pts[-1] != q:
            pts.append(q)
    if len(pts) > 1 and pts[0] == pts[-1]:
        pts.pop()
    if len(pts) < 3:
        return [], "no area"
    a = np.array(pts)
    if _crosses(a):
        return [], "crosses itself"
    b = np.roll(a, -1, 0)
    area = math.fsum(np.concatenate([*_two_product(a[:, 0], b[:, 1]), *_two_product(-a[:, 1], b[:, 0])]).tolist())
    if area == 0:
        return [], "no area"
    return pts[::-1] if area < 0 else pts, None


def clip_ring(ring: Sequence[tuple[float, float]]) -> tuple[list[tuple], str | None]:
    """(triangles, fault): the counter-clockwise triangles of a simple polygon, or none and the fault of the ring.

    A closing vertex equal to the first one, repeated and collinear vertices are allowed. Faults: incomplete vertex
    (null, NaN or infinite), no area (fewer than three distinct vertices too), crosses itself. Only the reflex vertices in
    the range of an ear's x are tested, and after each ear only its neighbours change, so long borders are no quadratic work.
    """
    pts, fault = _ring(ring)
    if fault:
        return [], fault
    n = len(pts)
    xs, ys = np.array([p[0] for p in pts]), np.array([p[1] for p in pts])
    before, after, alive = [n - 1, *range(n - 1)], [*range(1, n), 0], [True] * n
    turn = lambda i: _turn(pts[before[i]], pts[i], pts[after[i]])
    reflex = np.array([turn(i) <= 0 for i in range(n)])
    by_x = np.flatnonzero(reflex)
    by_x = by_x[np.argsort(xs[by_x], kind="stable")]
    sorted_x, dead = xs[by_x], 0

    def empty(i: int) -> bool:
        a, b, c = pts[before[i]], pts[i], pts[after[i]]
        lo, hi = np.searchsorted(sorted_x, min(a[0], b[0], c[0]), "left"), np.searchsorted(sorted_x, max(a[0], b[0], c[0]), "right")
        own = by_x[lo:hi]
        py = ys[own]
        own = own[reflex[own] & (py >= min(a[1], b[1], c[1])) & (py <= max(a[1], b[1], c[1]))]
        if not len(own):
            return True
        px, py = xs[own], ys[own]
        inside = ~(((px == a[0]) & (py == a[1])) | ((px == b[0]) & (py == b[1])) | ((px == c[0]) & (py == c[1])))
        for u, v in ((a, b), (b, c), (c, a)):
            inside &= sides(u[0], u[1], v[0], v[1], px, py) >= 0
        return not inside.any()

    out, left, todo, waiting, moved = [], n, deque(range(n)), [True] * n, False
    while left > 3:
        if not todo:
            if not moved:
                return [], "crosses itself"  # or touches itself in a way that leaves no ear
            todo, moved = deque(i for i in range(n) if alive[i]), False
            for i in todo:
                waiting[i] = True
        i = todo.popleft()
        waiting[i] = False
        if not alive[i]:
            continue
        way = turn(i)
        if way < 0 or (way > 0 and not empty(i)):
            continue
        p, q = before[i], after[i]
        if way > 0:
            out.append((pts[p], pts[i], pts[q]))
        alive[i], moved, left = False, True, left - 1
        after[p], before[q] = q, p
        dead += bool(reflex[i])
        reflex[i] = False
        for k in (p, q):
            if reflex[k] and turn(k) > 0:
                reflex[k] = False
                dead += 1
            if not waiting[k]:
                todo.append(k)
                waiting[k] = True
        if dead > 64 and dead * 2 > len(by_x):
            by_x = by_x[reflex[by_x]]
            sorted_x, dead = xs[by_x], 0
    rest = [i for i in range(n) if alive[i]][0]
    if turn(rest) > 0:
        out.append((pts[before[rest]], pts[rest], pts[after[rest]]))
    return out, None


def ear_clip(ring: Sequence[tuple[float, float]]) -> list[tuple]:
    """The triangles of clip_ring."""
    return clip_ring(ring)[0]


def _pairs_of(ring) -> list:
    return [None if p is None else tuple(p.values()) if isinstance(p, dict) else tuple(p) for p in ring]


def _region_columns(regions: DataFrame, region_id: str, ring: str, t1: str, t2: str) -> DataFrame:
    return regions.select(
        F.col(f"`{region_id}`").cast("bigint").alias("region_id"), F.col(f"`{ring}`").alias("ring"),
        F.col(f"`{t1}`").cast("double").alias("t1"), F.col(f"`{t2}`").cast("double").alias("t2"),
    )


def triangulate(regions: DataFrame, region_id: str = "region_id", ring: str = "ring", t1: str = "t1", t2: str = "t2") -> DataFrame:
    """Triangles of regions: ring is array<struct<x, y>>. A region without id, one whose time range is null, NaN, empty or
    turned over, and one whose ring has a fault (see region_faults) has none: never some of its triangles."""
    usable = _region_columns(regions, region_id, ring, t1, t2).where("region_id is not null and ring is not null and t1 < t2 and not isnan(t2)")

    def clip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                rows += [(r.region_id, *a, *b, *c, r.t1, r.t2) for a, b, c in ear_clip(_pairs_of(r.ring))]
            yield pd.DataFrame(rows, columns=["region_id", "ax", "ay", "bx", "by", "cx", "cy", "t1", "t2"])

    return usable.mapInPandas(clip, TRIANGLE)


def region_faults(regions: DataFrame, region_id: str = "region_id", ring: str = "ring", t1: str = "t1", t2: str = "t2") -> DataFrame:
    """(region_id, fault) of the regions that contain nothing: no id, no ring, no time, incomplete vertex, no area, crosses itself.

    Repeated regions are reported each; an empty table gives no rows, other columns play no part."""
    found = _region_columns(regions, region_id, ring, t1, t2)
    timed = F.coalesce((F.col("t1") < F.col("t2")) & ~F.isnan("t2"), F.lit(False))
    early = F.when(F.col("region_id").isNull(), "no id").when(F.col("ring").isNull(), "no ring").when(~timed, "no time")

    def faults(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fault = [e if isinstance(e, str) else clip_ring(_pairs_of(r))[1] for e, r in zip(pdf["early"], pdf["ring"])]
            yield pd.DataFrame({"region_id": pdf["region_id"].astype("Int64"), "fault": fault})

    return found.select("region_id", "ring", early.alias("early")).mapInPandas(faults, "region_id bigint, fault string").where("fault is not null")


def rings_of_boxes(boxes: DataFrame, box_id: str) -> DataFrame:
    """(region_id, ring, t1, t2) of boxes t1, x1, y1, t2, x2, y2; flat, turned over and incomplete boxes, which contain nothing, are left out."""
    good = F.col(f"`{box_id}`").isNotNull()
    for d in "txy":
        low, high = F.col(f"{d}1"), F.col(f"{d}2")
        good &= (low < high) & ~F.isnan(low) & ~F.isnan(high)
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"))
    return boxes.where(F.coalesce(good, F.lit(False))).select(F.col(f"`{box_id}`").alias("region_id"), ring.alias("ring"), "t1", "t2")


# --- hierarchies ---------------------------------------------------------------------------------------------------


def in_triangle(p: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Row by row: location (t, x, y) in counter-clockwise triangle and [t1, t2), edges by the rule of this module."""
    inside = (p[:, 0] >= tri[:, 6]) & (p[:, 0] < tri[:, 7])
    for i, j in ((0, 2), (2, 4), (4, 0)):
        ax, ay, bx, by = tri[:, i], tri[:, i + 1], tri[:, j], tri[:, j + 1]
        side = sides(ax, ay, bx, by, p[:, 1], p[:, 2])
        inside &= (side > 0) | ((side == 0) & ((by < ay) | ((by == ay) & (bx > ax))))
    return inside


class Hierarchy:
    """Bounding volumes over triangles; queried for many locations at once."""

    def __init__(self, tri: np.ndarray, ids: np.ndarray):
        """tri: rows ax, ay, bx, by, cx, cy, t1, t2; ids: the region of each."""
        self.tri, self.ids = np.asarray(tri, float).reshape(-1, 8), np.asarray(ids)
        self.volumes = Volumes(*_around(self.tri))

    def pairs(self, p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of p, region ids) for locations p (columns t, x, y) in regions."""
        for row, item in self.volumes.candidates(p):
            hit = in_triangle(p[row], self.tri[item])
            yield row[hit], self.ids[item[hit]]

    def locate(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All of pairs, each pair once."""
        found = [*self.pairs(p)]
        if not found:
            return np.empty(0, int), self.ids[:0]
        pairs = pd.DataFrame({"row": np.concatenate([r for r, _ in found]), "id": np.concatenate([i for _, i in found])}).drop_duplicates()
        return pairs["row"].to_numpy(), pairs["id"].to_numpy()


def _around(tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and high corners (t, x, y) of the boxes around triangles."""
    if not len(tri):
        return np.empty((0, 3)), np.empty((0, 3))
    xs, ys = tri[:, 0:6:2], tri[:, 1:6:2]
    return np.column_stack([tri[:, 6], xs.min(1), ys.min(1)]), np.column_stack([tri[:, 7], xs.max(1), ys.max(1)])


# --- regions of locations ------------------------------------------------------------------------------------------

_LOCATED = "point_id is not null and t is not null and x is not null and y is not null and not isnan(t) and not isnan(x) and not isnan(y)"


def _points(points: DataFrame) -> DataFrame:
    return points.select(F.col("point_id").cast("bigint"), *[F.col(c).cast("double").alias(c) for c in "txy"]).where(_LOCATED)


def regions_of(points: DataFrame, regions: DataFrame, bound: int = BROADCAST_TRIANGLES, leaf_rows: int = LEAF_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(region_id, point_id) for points (point_id, t, x, y) and regions (region_id, ring, t1, t2), each pair once.

    A point whose id or a coordinate is null or NaN has no location and is in no region. Repeated points and regions
    give their pairs once. A region with a fault (see region_faults) contains nothing. Other columns play no part; empty
    inputs give an empty result.
    """
    pts = _points(points)
    tris = triangulate(regions)
    few = tris.limit(bound + 1).toPandas()
    if len(few) <= bound:
        tree = points.sparkSession.sparkContext.broadcast(Hierarchy(few.iloc[:, 1:].to_numpy(), few["region_id"].to_numpy()))

        def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                row, region = tree.value.locate(pdf[["t", "x", "y"]].to_numpy())
                yield pd.DataFrame({"region_id": region.astype("int64"), "point_id": pdf["point_id"].to_numpy()[row]})

        return pts.mapInPandas(locate, "region_id bigint, point_id bigint").distinct()
    return _regions_by_leaf(pts, cut(tris), leaf_rows, slice_rows).distinct()  # triangulated once


class _Regions:
    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.tree = ids, Hierarchy(values, ids)

    def find(self, ids: np.ndarray, values: np.ndarray, role: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return ((region, ids[row]) for row, region in self.tree.pairs(values[:, :3]))


def _regions_by_leaf(pts: DataFrame, tris: DataFrame, leaf_rows: int, slice_rows: int) -> DataFrame:
    names = ["ax", "ay", "bx", "by", "cx", "cy", "t1", "t2"]
    n_home, n_guest = tris.count(), pts.count()
    wanted = wanted_rows(n_home + n_guest, leaf_rows)
    reach = lambda s: _around(s) if s.shape[1] == 8 else (s, s)
    top = pts.sparkSession.sparkContext.broadcast(Top(sample_of(tris, names, n_home, wanted), n_home, sample_of(pts, "txy", n_guest, wanted), n_guest, reach, leaf_rows, slice_rows))

    def place(columns: list[str], ids: str, home: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                own, at = pdf[ids].to_numpy("int64"), pdf[columns].to_numpy(float)
                row, leaf = leaves_of(top.value.nodes, *reach(at))
                copy, task = top.value.spread(leaf, mixed_hash(own[row], at[row]), home)
                yield placed_rows(task, HOME if home else VISITOR, own[row][copy], at[row][copy], 8)

        return run

    placed = tris.mapInPandas(place(names, "region_id", True), placed_schema(8)).unionByName(pts.mapInPandas(place([*"txy"], "point_id", False), placed_schema(8)))
    return work(placed, top.value.tasks(), 8, _Regions, None, "region_id bigint, point_id bigint")


# --- near locations ------------------------------------------------------------------------------------------------


class _Near:
    """Homes as boxes of the distance around their locations."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, distance: float, ordered: bool):
        self.ids, self.at = once(ids, at)
        self.distance, self.ordered = distance, ordered
        self.volumes = Volumes(self.at - _wide(distance), self.at + _wide(distance))
        order = self.volumes.order[self.volumes.order >= 0]
        self.rows = self.ids[order], self.at[order]  # neighbours follow each other, which memory likes

    def find(self, ids: np.ndarray, at: np.ndarray, role: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for row, item in self.volumes.candidates(at):
            a, b = ids[row], self.ids[item]
            # Locations of one leaf meet twice, once from either side.
            good = np.flatnonzero(a < b if role == FELLOW else a != b if self.ordered else np.ones(len(a), bool))
            d = at[row[good]] - self.at[item[good]]
            d *= d
            good = good[np.sqrt(d[:, 0] + d[:, 1] + d[:, 2]) <= self.distance]
            a, b = a[good], b[good]
            yield (np.minimum(a, b), np.maximum(a, b)) if self.ordered else (a, b)


def _wide(distance: float) -> float:
    return distance * (1 + 1e-6)  # more than rounding takes away


def near_pairs(points: DataFrame, distance: float, leaf_rows: int = LEAF_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(a_id, b_id), a_id < b_id, of points (point_id, t, x, y) with different ids at most ``distance`` apart in (t, x, y).

    Points without id or location take no part; a repeated point counts once, an id with several locations has all of them,
    and each pair of ids appears once. The distance is tested exactly as sqrt(dt*dt + dx*dx + dy*dy) <= distance. Points at
    the same place are all pairs: the result asks for them. Other columns play no part; an empty table gives no pairs.

    A point is at home in one leaf of the top hierarchy and visits the leaves of higher number within the distance.
    """
    return _by_leaf(points, None, distance, leaf_rows, slice_rows).distinct()


def distance_join(a: DataFrame, b: DataFrame, distance: float, leaf_rows: int = LEAF_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(a_id, b_id) of points of two tables (point_id, t, x, y) at most ``distance`` apart; rows are taken as in near_pairs, equal ids included."""
    return _by_leaf(b, a, distance, leaf_rows, slice_rows).distinct()


def _by_leaf(homes: DataFrame, guests: DataFrame | None, distance: float, leaf_rows: int, slice_rows: int) -> DataFrame:
    if not distance > 0 or distance == math.inf:
        raise ValueError("distance must be above 0 and finite")
    alone = guests is None
    sides_ = [_points(homes)] if alone else [_points(homes), _points(guests)]
    counts = [d.count() for d in ([homes] if alone else [homes, guests])]
    wanted = wanted_rows(sum(counts), leaf_rows)
    samples = [sample_of(d, "txy", n, wanted) for d, n in zip(sides_, counts)]
    top = homes.sparkSession.sparkContext.broadcast(Top(samples[0], counts[0], samples[-1], counts[-1], lambda s: (s, s), leaf_rows * (2 if alone else 1), slice_rows))

    def place(home: bool, guest: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            t = top.value
            for pdf in batches:
                ids, at = once(pdf["point_id"].to_numpy("int64"), pdf[["t", "x", "y"]].to_numpy(float))
                mixed = mixed_hash(ids, at)
                own = np.zeros(len(ids), int)
                if home:
                    row, leaf = leaves_of(t.nodes, at, at)
                    own[row] = leaf
                    row, task = t.spread(own, mixed, True)
                    yield placed_rows(task, HOME, ids[row], at[row], 3)
                if guest:
                    row, leaf = leaves_of(t.nodes, at - _wide(distance), at + _wide(distance))
                    if home:
                        later = leaf > own[row]
                        row, leaf = row[later], leaf[later]
                        several = np.flatnonzero((t.slices[0] * t.slices[1])[own] > 1)
                        copy, task = t.spread(own[several], mixed[several], False)
                        yield placed_rows(task, FELLOW, ids[several[copy]], at[several[copy]], 3)
                    copy, task = t.spread(leaf, mixed[row], False)
                    yield placed_rows(task, VISITOR, ids[row[copy]], at[row[copy]], 3)

        return run

    schema, sliced = placed_schema(3), top.value.sliced()
    placed = [sides_[0].mapInPandas(place(True, alone), schema)] + [d.mapInPandas(place(False, True), schema) for d in sides_[1:]]
    build = lambda ids, at: _Near(ids, at, float(distance), alone)
    return work(reduce(DataFrame.unionByName, placed), top.value.tasks(), 3, build, (lambda task: not sliced[task]) if alone else None, "a_id bigint, b_id bigint")
