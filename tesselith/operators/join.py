"""Spatial joins as equi-joins on cells: no nested loops, whatever the sizes of the boxes.

Boxes are put on levels whose cells double in width, each on the lowest level where it spans at most two cells in each
dimension; levels go down as well as up, so huge boxes don't make the cells of small ones wide. Two boxes meet on the higher
of their levels: a box is listed in its cells there and on every higher level that the other side uses, which are at most a
few dozen however large the data, and meets there the boxes that are at home on that level. A pair that shares several
cells is reported in the one that holds the low corner of the common part. A side of few rows is broadcast after they are
counted; otherwise cells with many rows are split by the adaptive skew join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselith.functions import geometry as G
from tesselith.model import AXES, Boundary
from tesselith.operators.leaves import HOME, LEAF_ROWS, SLICE_ROWS, VISITOR, Places, Top, leaves_of, mixed_hash, once, placed_rows, placed_schema, sample_of, wanted_rows, work
from tesselith.session import cut

#: Boxes that are broadcast, with their cells on all levels (some 200 bytes for each of about 8 a level).
FEW_BOXES = 10_000
#: Groups of boxes by the powers of two of their extents; levels at most, below and above the first: doubles end there.
GROUPS, MAX_LEVEL = 40_000, 2100


def _known(names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out &= F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(F.col(n)) < float("inf"))
    return out


def _extent(a: str) -> Column:
    return F.col(f"{a}2") - F.col(f"{a}1")


def _power(a: str, step: int) -> Column:
    """The least multiple e of step for which 2 ** e is not below the extent; null without extent."""
    return F.when(_extent(a) > 0, F.ceil(F.ceil(F.log2(_extent(a))) / step) * step).cast("int")


@dataclass
class _Levels:
    """What one aggregation per side tells: widths of level 0 as powers of two, the step of levels, the lowest one, and per
    side the levels in use and whether it has few boxes."""

    powers: list[int]
    step: int
    low: int
    used: list[list[int]]
    few: list[bool]

    @classmethod
    def of(cls, widths: tuple[float, float, float] | None, *sides: DataFrame) -> _Levels:
        """By default level 0 is as wide as the median extent, of those above 0, in each dimension; as levels go down and up
        from there, only the proportions of the dimensions depend on it. On the lowest level the numbers of cells are still
        exact. Extents are grouped by powers of 2 ** step, which is more than 1 only if there are too many groups."""
        for step in (1, 8, 64):
            found = [df.groupBy(*[_power(a, step).alias(a) for a in AXES]).agg(F.count(F.lit(1)).alias("n"), *[F.max(F.greatest(F.abs(f"{a}1"), F.abs(f"{a}2"))).alias(f"m{a}") for a in AXES]).limit(GROUPS + 1).collect() for df in sides]
            if all(len(f) <= GROUPS for f in found):
                break
        powers = []
        for i, a in enumerate(AXES):
            sizes = Counter()
            for f in found:
                sizes.update({r[a]: 0 for r in f if r[a] is not None})
                for r in f:
                    if r[a] is not None:
                        sizes[r[a]] += r["n"]
            half, up = sum(sizes.values()) / 2, accumulate(n for _, n in sorted(sizes.items()))
            middle = next((e for e, n in zip(sorted(sizes), up) if n >= half), 0)
            powers.append(middle if widths is None else round(math.log2(widths[i])))
        far = [max((r[f"m{a}"] for f in found for r in f), default=0.0) for a in AXES]
        least = max(math.ceil(math.log2(f)) - 50 - p if f > 0 else -MAX_LEVEL for f, p in zip(far, powers))
        own = [[max((r[a] - p for a, p in zip(AXES, powers) if r[a] is not None), default=None) for r in f] for f in found]
        low = max(least, min([l for ls in own for l in ls if l is not None], default=0))
        return cls(powers, step, low, [sorted({max(low, low if l is None else l) for l in ls}) for ls in own], [sum(r["n"] for r in f) <= FEW_BOXES for f in found])

    def level(self) -> Column:
        """The level of a box; one without extent is on the lowest."""
        return F.greatest(F.lit(self.low), *[_power(a, self.step) - p for a, p in zip(AXES, self.powers)]).cast("int")

    def widths(self, level: Column) -> list[Column]:
        return [F.pow(F.lit(2.0), level + p) for p in self.powers]

    def listed(self, df: DataFrame, prefix: str, home: bool, others: list[int] = ()) -> DataFrame:
        """Rows of boxes once for each of their cells on their own level (home) and on the higher ones of others; columns get the prefix."""
        rows = df.withColumn("__own", self.level())
        higher = F.filter(F.array(*[F.lit(v) for v in others]).cast("array<int>"), lambda l: l > F.col("__own"))
        rows = rows.withColumn("__level", F.explode(F.concat(F.array("__own"), higher) if home else higher))
        for a, w in zip(AXES, self.widths(F.col("__level"))):
            rows = rows.withColumn(f"__c{a}", F.explode(F.sequence(F.floor(F.col(f"{a}1") / w), F.floor(F.col(f"{a}2") / w))))
        return rows.select(*[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in df.columns], *_MEET)


_MEET = ["__level", "__ct", "__cx", "__cy"]


def intersects_join(a: DataFrame, b: DataFrame, widths: tuple[float, float, float] | None = None) -> DataFrame:
    """Pairs of boxes of a and b that overlap openly: all columns, a's with the prefix a_ and b's with b_.

    Boxes with a null, NaN or infinite coordinate and inverted ones overlap nothing; one without extent is in a
    pair only if it lies inside the other; of two without extent none does. Repeated rows give repeated pairs.
    widths: proportions of the cells (t, x, y), by default from the median extents.
    """
    names = [f"{n}{i}" for i in "12" for n in AXES]
    upright = F.lit(True)
    for n in AXES:
        upright &= F.col(f"{n}1") <= F.col(f"{n}2")
    a, b = a.where(_known(names) & upright), b.where(_known(names) & upright)
    levels = _Levels.of(widths, a, b)
    (used_a, used_b), (few_a, few_b) = levels.used, levels.few
    first = F.lit(True)
    for n, w in zip(AXES, levels.widths(F.col("__level"))):
        first &= F.floor(F.greatest(F.col(f"a_{n}1"), F.col(f"b_{n}1")) / w) == F.col(f"__c{n}")

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        left, right = (F.broadcast(left) if few_a and not few_b else left), (F.broadcast(right) if few_b else right)
        pairs = left.join(right, _MEET).where(first & G.intersects("a_", "b_"))
        return pairs.select(*[F.col(f"`a_{c}`") for c in a.columns], *[F.col(f"`b_{c}`") for c in b.columns])

    # On the level where they meet, a is at home, or a comes from a lower one and b is at home.
    both = met(levels.listed(a, "a_", True), levels.listed(b, "b_", True, used_a))
    if not any(l > used_a[0] for l in used_b) if used_a else True:
        return both
    return both.unionByName(met(levels.listed(a, "a_", False, used_b), levels.listed(b, "b_", True)))


def point_in_box_join(points: DataFrame, boxes: DataFrame, boundary: Boundary | str = Boundary.HALF_OPEN, widths: tuple[float, float, float] | None = None) -> DataFrame:
    """Pairs of a point and a box that holds it: all columns, the points' with the prefix p_, the boxes' with b_.

    Points and boxes with null, NaN or infinite coordinates are in no pair; repeated rows give repeated pairs."""
    points = points.where(_known(list(AXES)))
    boxes = boxes.where(_known([f"{n}{i}" for i in "12" for n in AXES]) & (F.col("t1") <= F.col("t2")) & (F.col("x1") <= F.col("x2")) & (F.col("y1") <= F.col("y2")))
    levels = _Levels.of(widths, boxes)
    right = levels.listed(boxes, "b_", True)
    if levels.few[0]:
        right = F.broadcast(right)
    left = points.withColumn("__level", F.explode(F.array(*[F.lit(v) for v in levels.used[0]]).cast("array<int>")))
    cells = [F.floor(F.col(n) / w).alias(f"__c{n}") for n, w in zip(AXES, levels.widths(F.col("__level")))]
    left = left.select(*[F.col(f"`{c}`").alias(f"p_{c}") for c in points.columns], "__level", *cells)
    met = left.join(right, _MEET).where(G.within("b_", boundary, "p_"))
    return met.select(*[F.col(f"`p_{c}`") for c in points.columns], *[F.col(f"`b_{c}`") for c in boxes.columns])


def best_cell_join(boxes: DataFrame, cells: DataFrame, box_id: str) -> DataFrame:
    """(box_id, cell_id, common): for every box the cell of any cell table with the largest common area in (x, y), of equal ones the lowest id."""
    pairs = intersects_join(boxes, cells)
    common = (F.least("a_x2", "b_x2") - F.greatest("a_x1", "b_x1")) * (F.least("a_y2", "b_y2") - F.greatest("a_y1", "b_y1"))
    best = pairs.groupBy(F.col(f"a_{box_id}").alias(box_id)).agg(F.max(F.struct(common.alias("common"), (-F.col("b_cell_id")).alias("neg"))).alias("m"))
    return best.select(box_id, (-F.col("m.neg")).alias("cell_id"), F.col("m.common").alias("common"))


def knn(df: DataFrame, point: tuple[float, float, float], k: int, ids: str, scale: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """The k rows nearest to a point, with distance, ties by id: df's columns and dist. Boxes are measured to their
    farthest corner. Rows with null or NaN coordinates are nowhere. Each task keeps its k nearest only."""
    names = [f"{n}{i}" for i in "12" for n in AXES] if "t1" in df.columns and "t" not in df.columns else list(AXES)
    good = df.where(" and ".join(f"{n} is not null and not isnan({n})" for n in names))
    parts = []
    for n, q, s in zip(AXES, point, scale):
        d = F.col(n) - F.lit(float(q)) if len(names) == 3 else F.greatest(F.lit(float(q)) - F.col(f"{n}1"), F.col(f"{n}2") - F.lit(float(q)))
        parts.append(d if s == 1 else d * F.lit(float(s)))
    dist = F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2])
    return good.withColumn("dist", dist).orderBy("dist", f"`{ids}`").limit(k)


class _Bounds:
    """Distances within which guests have k homes of their task."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, k: int):
        self.places, self.k = Places(*once(ids, at[:, :3])), k

    def find(self, ids: np.ndarray, at: np.ndarray, role: int) -> Iterator[tuple]:
        yield ids, *at[:, :3].T, self.places.bound(at[:, :3], self.k)


class _Nearest(_Bounds):
    """The k nearest homes within the distance that guests bring along."""

    def find(self, ids: np.ndarray, at: np.ndarray, role: int) -> Iterator[tuple]:
        return ((ids[row], found, d) for row, found, d in self.places.nearest(at[:, :3], at[:, 3], self.k))


def knn_join(left: DataFrame, right: DataFrame, k: int, leaf_rows: int = LEAF_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(left_id, right_id, dist, rank): for each point of left (id, t, x, y) its k nearest of right (id, t, x, y), ties by id.

    Right lies in the leaves of a hierarchy cut on a sample of it. A point of left first meets the rows of its own leaf,
    which gives a distance within which it has k neighbours; then it visits the leaves within that distance, and each keeps
    its k nearest. So right is placed twice, whatever the density, and a point far from everything costs at most k rows for
    each leaf. Repeated rows count once; points without id or location take no part; an id of left with two locations has
    the nearest of both, an id of right with two can come twice. A left point has fewer neighbours only if right has fewer.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    clean = lambda d: d.select(F.col("id").cast("bigint").alias("id"), *[F.col(a).cast("double").alias(a) for a in AXES]).where(_known(list(AXES)) & F.col("id").isNotNull())
    counts = left.count(), right.count()
    left, right = clean(left).distinct(), clean(right)
    wanted = wanted_rows(counts[1], leaf_rows)
    samples = [sample_of(d, AXES, n, wanted) for d, n in zip((left, right), counts)]
    top = left.sparkSession.sparkContext.broadcast(Top(samples[1], counts[1], samples[0], counts[0], lambda s: (s, s), leaf_rows, slice_rows, by_home=True))

    def place(home: bool, visit: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            t = top.value
            for pdf in batches:
                ids, at = pdf["id"].to_numpy("int64"), pdf[list(AXES)].to_numpy(float)
                reach = pdf["reach"].to_numpy(float)[:, None] if visit else 0.0
                if home:
                    ids, at = once(ids, at)
                row, leaf = leaves_of(t.nodes, at - reach, at + reach)
                mixed = mixed_hash(ids, at)[row]
                if home or visit:
                    copy, task = t.spread(leaf, mixed, home)
                else:  # one slice of the homes will do
                    copy, task = np.arange(len(row)), t.first[leaf] + mixed % t.slices[0][leaf] * t.slices[1][leaf] + mixed % t.slices[1][leaf]
                own = np.column_stack([at, reach]) if visit else at
                yield placed_rows(task, HOME if home else VISITOR, ids[row][copy], own[row][copy], 4)

        return run

    homes = right.mapInPandas(place(True, False), placed_schema(4))
    guests = left.mapInPandas(place(False, False), placed_schema(4))
    tasks = top.value.tasks()
    reached = cut(work(homes.unionByName(guests), tasks, 4, lambda ids, at: _Bounds(ids, at, k), None, "id bigint, t double, x double, y double, reach double"))
    visits = reached.mapInPandas(place(False, True), placed_schema(4))
    found = work(homes.unionByName(visits), tasks, 4, lambda ids, at: _Nearest(ids, at, k), None, "left_id bigint, right_id bigint, dist double")
    order = Window.partitionBy("left_id").orderBy("dist", "right_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
