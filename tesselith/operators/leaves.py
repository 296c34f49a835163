"""Joins of rows in space, leaf by leaf of a hierarchy.

A top hierarchy is cut at the medians of a bounded sample until its leaves hold about LEAF_ROWS rows. Homes lie in all leaves
they touch (locations in one), guests visit the leaves they reach, and in every leaf a hierarchy over its homes gives the
candidates for its guests. Homes are held by a task, guests streamed. A leaf that the sample says is still too large, as its
rows are at one place, is worked off in slices, so that no task holds more than SLICE_ROWS homes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a leaf of the top hierarchy, sampled rows for each leaf, leaves at most (the sample and the hierarchy, which
#: are at the driver and in every task, are bounded by them), and homes of a task.
LEAF_ROWS, LEAF_SAMPLE, TOP_LEAVES, SLICE_ROWS = 20_000, 50, 20_000, 1_000_000
#: Partitions of a leaf join at most; tasks beyond them share partitions one after another.
_PARTITIONS = 20_000
#: Guests looked up at once, and pairs of guest and home tested at once.
GUESTS, PAIRS = 16_384, 2_000_000


class Volumes:
    """A hierarchy of bounding volumes over boxes, each level halved at the median of its widest axis; built and queried
    level by level for all boxes and locations at once. All volumes of a level have equally many places, so a level is
    one array; places that no box is left for hold -1."""

    LEAF = 8

    def __init__(self, low: np.ndarray, high: np.ndarray):
        n = len(low)
        self.order, self.levels, self.depth = np.empty(0, int), [], 0
        if not n:
            return
        self.depth = max(0, math.ceil(math.log2(n / self.LEAF)))
        own = np.zeros(-(-n // 2**self.depth) * 2**self.depth, int)  # the places left over repeat box 0
        own[:n] = np.arange(n)
        spare = np.arange(len(own)) >= n
        at = np.ascontiguousarray(np.clip(low / 2 + high / 2, -1e300, 1e300)[own].T)
        for level in range(self.depth):
            at = at.reshape(3, 2**level, -1)
            axis = np.argmax(at.max(2) - at.min(2), 0)
            values = at[axis, np.arange(2**level)]
            half = np.argpartition(values, values.shape[1] // 2, axis=1)
            half += (np.arange(2**level) * values.shape[1])[:, None]
            half = half.ravel()
            at, own, spare = at.reshape(3, -1)[:, half], own[half], spare[half]
        # The bounds from below: of the boxes, then of pairs of volumes.
        lows, highs = (np.ascontiguousarray(v[own].T).reshape(3, 2**self.depth, -1) for v in (low, high))
        lows, highs = lows.min(2), highs.max(2)
        for _ in range(self.depth + 1):
            self.levels.insert(0, (lows, highs))
            if lows.shape[1] > 1:
                lows, highs = np.minimum(lows[:, ::2], lows[:, 1::2]), np.maximum(highs[:, ::2], highs[:, 1::2])
        self.order = np.where(spare, -1, own)

    def places(self, level: int) -> np.ndarray:
        """The boxes of each volume of a level, one row a volume."""
        return self.order.reshape(2**level, -1)

    def candidates(self, p: np.ndarray, reach: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of p, numbers of boxes) of boxes that may hold them, faces included, or that may be within reach of them;
        in portions of bounded size, the rows of p in order from portion to portion."""
        if not self.levels:
            return
        axes = np.ascontiguousarray(p.T)
        for first in range(0, len(p), GUESTS):
            who, node = np.arange(first, min(len(p), first + GUESTS)), np.zeros(min(len(p), first + GUESTS) - first, int)
            for level, (low, high) in enumerate(self.levels):
                if level:
                    who, node = np.repeat(who, 2), np.column_stack([node * 2, node * 2 + 1]).ravel()
                far = 0.0
                for axis in range(3):
                    v, l, h = axes[axis][who], low[axis][node], high[axis][node]
                    if reach is None:  # what one axis tells apart, the next needn't look at
                        inside = (v >= l) & (v <= h)
                        who, node = who[inside], node[inside]
                    else:
                        gap = np.maximum(np.maximum(l - v, v - h), 0)
                        far = far + gap * gap
                if reach is not None:
                    inside = np.sqrt(far) <= reach[who]
                    who, node = who[inside], node[inside]
            wide = self.places(self.depth).shape[1]
            step = max(1, PAIRS // wide)
            for start in range(0, len(who), step):
                items = self.places(self.depth)[node[start : start + step]]
                there = items >= 0
                yield np.repeat(who[start : start + step], there.sum(1)), items[there]


class Places:
    """Locations with ids, and the nearest ones of them for many others at once."""

    def __init__(self, ids: np.ndarray, at: np.ndarray):
        self.ids, self.at = ids, at
        self.volumes = Volumes(at, at)

    def bound(self, p: np.ndarray, k: int) -> np.ndarray:
        """For each row of p, a distance within which there are k of the locations; infinite if there are fewer in all."""
        n, v = len(self.ids), self.volumes
        out = np.full(len(p), np.inf)
        if n < k:
            return out
        depth = max(0, min(v.depth, int(math.log2(n / k)) - 1))
        while depth and (v.places(depth) >= 0).sum(1).min() < k:  # its volumes hold k at least
            depth -= 1
        for first in range(0, len(p), block := max(1, PAIRS // (8 * k + 8))):
            q = p[first : first + block]
            node = np.zeros(len(q), int)
            for low, high in v.levels[1 : depth + 1]:
                gaps = [np.maximum(np.maximum(low[:, c] - q.T, q.T - high[:, c]), 0) for c in (node * 2, node * 2 + 1)]
                left, right = ((g * g).sum(0) for g in gaps)
                node = node * 2 + (right < left)
            items = v.places(depth)[node]
            d = np.sqrt(((self.at[items] - q[:, None]) ** 2).sum(2))
            d[items < 0] = np.inf
            out[first : first + block] = np.partition(d, k - 1, axis=1)[:, k - 1]
        return out

    def nearest(self, p: np.ndarray, reach: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of p, ids, distances): of the locations within reach the k nearest of each row, ties by id, or more of them."""
        reach = reach * (1 + 1e-12)  # more than rounding takes away
        for row, item in self.volumes.candidates(p, reach):
            d = p[row] - self.at[item]
            d *= d
            d = np.sqrt(d[:, 0] + d[:, 1] + d[:, 2])
            near = np.flatnonzero(d <= reach[row])
            row, item, d = row[near], self.ids[item[near]], d[near]
            order = np.lexsort((item, d, row))
            row, item, d = row[order], item[order], d[order]
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.empty(0, int)
            place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
            yield row[place < k], item[place < k], d[place < k]


def cuts_of(centres: np.ndarray, leaves: int) -> list[tuple]:
    """A top hierarchy as nodes (axis, value, left, right); negative children are leaves -1 - number. All of space belongs to a leaf."""
    nodes: list[list] = []
    count = 0

    def cut(own: np.ndarray) -> tuple[int, float] | None:
        for axis in np.argsort(own.min(0) - own.max(0), kind="stable").tolist():
            v = own[:, axis]
            value = float(np.median(v))
            if not (v < value).any() and (v > value).any():
                value = float(v[v > value].min())
            if (v < value).any():
                return axis, value
        return None

    def grow(own: np.ndarray, budget: int) -> int:
        nonlocal count
        place = cut(own) if budget > 1 and len(own) > 1 else None
        if place:
            left = own[:, place[0]] < place[1]
            at = len(nodes)
            nodes.append([*place, 0, 0])
            part = min(budget - 1, max(1, round(budget * left.mean())))
            nodes[at][2] = grow(own[left], part)
            nodes[at][3] = grow(own[~left], budget - part)
            return at
        count += 1
        return -count

    grow(np.clip(centres, -1e300, 1e300), leaves)
    return [tuple(n) for n in nodes]


def leaves_of(nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for the leaves that closed boxes low..high touch; a location is a box without extent, left of a cut only if below it."""
    row, node = np.arange(len(low)), np.zeros(len(low), int)
    if not len(nodes):
        return row, node
    axes, kids = nodes[:, 0].astype(int), nodes[:, 2:].astype(int)
    rows, leaves = [], []
    while len(row):
        axis, value = axes[node], nodes[node, 1]
        left, right = low[row, axis] < value, high[row, axis] >= value
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([kids[node[left], 0], kids[node[right], 1]])
        done = node < 0
        rows.append(row[done])
        leaves.append(-1 - node[done])
        row, node = row[~done], node[~done]
    return np.concatenate(rows), np.concatenate(leaves)


HOME, VISITOR, FELLOW = 0, 1, 2


class Top:
    """A top hierarchy with the slices of its leaves: n_home x n_guest tasks for a leaf."""

    def __init__(self, home: np.ndarray, n_home: int, guest: np.ndarray, n_guest: int, reach: Callable, leaf_rows: int, slice_rows: int, by_home: bool = False):
        """home, guest: samples as rows of what reach turns into low and high corners; n_home, n_guest: all rows;
        by_home: whether leaves are cut by the homes alone."""
        boxes = [reach(s) if len(s) else (np.empty((0, 3)), np.empty((0, 3))) for s in (home, guest)]
        wanted = min(TOP_LEAVES, -(-(n_home + n_guest * (not by_home)) // leaf_rows))
        centres = np.concatenate([l / 2 + h / 2 for l, h in boxes[: 1 if by_home else 2]])
        self.nodes = np.array(cuts_of(centres, wanted) if len(centres) else [], float).reshape(-1, 4)
        leaves = len(self.nodes) + 1
        self.slices = []
        for (low, high), n, rows in zip(boxes, (n_home, n_guest), (slice_rows, 2 * slice_rows)):
            got = np.bincount(leaves_of(self.nodes, low, high)[1], minlength=leaves).astype(float)
            most = (got + 4 * np.sqrt(got) + 8) * (n / max(1, len(low)))  # of what a leaf holds, but for rare chance
            self.slices.append(np.maximum(1, np.ceil(np.minimum(most, n) / rows)).astype(int))
        self.first = np.concatenate([[0], np.cumsum(self.slices[0] * self.slices[1])])

    def tasks(self) -> int:
        return int(self.first[-1])

    def sliced(self) -> np.ndarray:
        """Whether a task is one of several of its leaf."""
        several = self.slices[0] * self.slices[1]
        return np.repeat(several > 1, several)

    def spread(self, leaf: np.ndarray, mixed: np.ndarray, home: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, task): a home goes to its slice for all slices of guests, a guest to its own for all slices of homes."""
        nh, ng = self.slices[0][leaf], self.slices[1][leaf]
        copies = ng if home else nh
        row = np.repeat(np.arange(len(leaf)), copies)
        other = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
        own = mixed[row] % (nh if home else ng)[row]
        i, j = (own, other) if home else (other, own)
        return row, self.first[leaf[row]] + i * ng[row] + j


def mixed_hash(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of rows, the same at every run."""
    h = ids.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)
    for column in np.ascontiguousarray(at, float).T:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.ascontiguousarray(column).view("uint64")
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(1)).astype("int64")


def once(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows without repetitions; only rows whose id is repeated are compared."""
    again = pd.Series(ids).duplicated(keep=False).to_numpy()
    if not again.any():
        return ids, at
    keep = ~again
    same = pd.DataFrame(np.column_stack([at[again] + 0.0])).assign(id=ids[again]).duplicated().to_numpy()
    keep[np.flatnonzero(again)[~same]] = True
    return ids[keep], at[keep]


def placed_rows(task: np.ndarray, role: int, ids: np.ndarray, values: np.ndarray, width: int) -> pd.DataFrame:
    out = {"task": task.astype("int64"), "role": np.full(len(task), role, "int8"), "id": ids}
    for c in range(width):
        out[f"c{c}"] = values[:, c] if c < values.shape[1] else np.nan
    return pd.DataFrame(out)


def placed_schema(width: int) -> str:
    return "task bigint, role tinyint, id bigint, " + ", ".join(f"c{c} double" for c in range(width))


def work(placed: DataFrame, tasks: int, width: int, build: Callable, own: Callable | None, schema: str) -> DataFrame:
    """Task by task: build(ids, values) makes the homes' structure, whose find(guests' ids, values, role) is returned as
    portions, each a tuple of arrays for the columns of schema. own(task): whether the homes are guests, too."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda found: (pd.DataFrame(dict(zip(names, f))) for f in found if len(f[0]))
        now, homes, made = None, [], None

        def ready() -> Iterator[pd.DataFrame]:
            nonlocal made, homes
            if made is None:
                ids, values = np.concatenate([h[0] for h in homes]), np.concatenate([h[1] for h in homes])
                made, homes = build(ids, values), []
                if own and own(now):
                    yield from frame(made.find(*made.rows, FELLOW))

        for pdf in batches:
            task, role, ids = pdf["task"].to_numpy(), pdf["role"].to_numpy(), pdf["id"].to_numpy("int64")
            values = pdf[[f"c{c}" for c in range(width)]].to_numpy(float)
            edges = np.flatnonzero((task[1:] != task[:-1]) | (role[1:] != role[:-1])) + 1
            for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(task)]):
                if start == stop:
                    continue
                if task[start] != now:
                    if homes:
                        yield from ready()
                    now, homes, made = task[start], [], None
                part = ids[start:stop], values[start:stop]
                if role[start] == HOME:
                    homes.append(part)
                else:
                    homes = homes or [(ids[:0], values[:0])]  # guests alone
                    yield from ready()
                    yield from frame(made.find(*part, role[start]))
        if homes:
            yield from ready()

    partitions = max(1, min(tasks, _PARTITIONS))
    spread = placed.repartitionById(partitions, F.pmod("task", F.lit(partitions)).cast("int")) if partitions > 1 else placed.coalesce(1)
    return spread.sortWithinPartitions("task", "role").mapInPandas(run, schema)


def sample_of(df: DataFrame, columns: Sequence[str], rows: int, wanted: int) -> np.ndarray:
    """About ``wanted`` of the ``rows`` rows, as an array."""
    share = min(1.0, wanted / max(1, rows))
    some = df.select(*columns)
    return (some if share == 1 else some.sample(False, share, 1)).toPandas().to_numpy(float).reshape(-1, len(columns))


def wanted_rows(n: int, leaf_rows: int) -> int:
    """Rows of a sample for n rows; with one leaf there is nothing to cut."""
    leaves = min(TOP_LEAVES, -(-n // leaf_rows))
    return leaves * LEAF_SAMPLE if leaves > 1 else 1


