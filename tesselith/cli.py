"""Command line: python -m tesselith.cli VERB [path...] [key:value...] [-flag...].

Verbs: rangequery, count, index, mbr, readfile, sample, generate, plot, and knn, join, tail, shuffle. Everything runs as
Spark plans it, on a cluster or not, and indexes are Parquet, so -local and columnar: are accepted and change nothing.
"""

from __future__ import annotations

import re
import sys
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.model import Box, Kind
from tesselith.operators import generate, join, range_query, raster, sample, stats
from tesselith.operators.grid import Grid, num_partitions
from tesselith.session import build_session
from tesselith.sources import index, text
from tesselith.sources.files import exists, files_of, write_bytes

_UNITS = {"k": 10, "m": 20, "g": 30, "t": 40}


def parse_size(value: str) -> int:
    """Bytes: a number, or N.k, N.m, N.g, N.t in binary units."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\.?([kmgtKMGT])?[bB]?", value)
    if not m:
        raise ValueError(f"not a size: {value!r}")
    return int(float(m[1]) * (1 << _UNITS[m[2].lower()])) if m[2] else int(float(m[1]))


@dataclass
class Arguments:
    paths: list[str] = field(default_factory=list)
    boxes: list[Box] = field(default_factory=list)
    values: dict[str, str] = field(default_factory=dict)
    flags: set[str] = field(default_factory=set)

    @classmethod
    def parse(cls, args: list[str]) -> Arguments:
        out = cls()
        for a in args:
            key, colon, value = a.partition(":")
            if a.startswith("-") and not colon:
                out.flags.add(a[1:])
            elif colon and not value.startswith("/"):
                if key in ("rect", "prism", "mbr"):
                    out.boxes.append(Box.parse(value))
                else:
                    out.values[key] = value
            else:
                out.paths.append(a)
        return out

    def get(self, key: str, default=None, kind=str):
        return kind(self.values[key]) if key in self.values else default

    @property
    def mode(self) -> str:
        return "overwrite" if "overwrite" in self.flags else "errorifexists"

    @property
    def box(self) -> Box | None:
        return self.boxes[0] if self.boxes else None

    def seed(self) -> int:
        import time

        return self.get("seed", int(time.time()), int)


def _shapes(spark: SparkSession, a: Arguments, path: str | None = None) -> DataFrame:
    path = path or a.paths[0]
    if index.is_index(spark, path):
        return index.read_index(spark, path).stored.drop(index.CELL)
    return text.read_shapes(spark, path, a.get("shape"))


def _put(df: DataFrame, a: Arguments, at: int = 1) -> int | None:
    """Writes rows to the path given, or prints all of them (the first show: of them, and says so); how many were printed."""
    if len(a.paths) > at:
        text.write_shapes(df, a.paths[at], a.mode)
        return None
    show, n = a.get("show", None, int), 0
    for r in (df if show is None else df.limit(show + 1)).toLocalIterator():
        if n == show:
            print(f"... only the first {show} are shown", file=sys.stderr)
            break
        print(",".join("" if v is None else str(v) for v in r))
        n += 1
    return n


def rangequery(spark: SparkSession, a: Arguments) -> None:
    """Boxes run side by side, concurrency: of them at once; the rows of each are counted as they pass."""
    kind, name, boundary = Kind(a.get("query", "get")), a.get("field"), a.get("boundary", "open")
    indexed = index.read_index(spark, a.paths[0]) if index.is_index(spark, a.paths[0]) else None
    df = None if indexed else _shapes(spark, a)

    def ask(number: int) -> int:
        box = a.boxes[number]
        rows = indexed.range_query(box, boundary=boundary) if indexed else range_query.range_query(df, box, boundary=boundary)
        if len(a.paths) > 1:
            rows, seen = stats.with_counters(rows, f"range_{number}")
            text.write_shapes(range_query.result_of(rows, kind, name), a.paths[1] if len(a.boxes) == 1 else f"{a.paths[1]}/range_{number}", a.mode)
            return seen.get["n_rows"]
        printed = _put(range_query.result_of(rows, kind, name), a)
        return printed if kind is Kind.GET and "show" not in a.values else rows.count()

    if len(a.paths) > 1:
        with ThreadPoolExecutor(max(1, min(len(a.boxes), a.get("concurrency", len(a.boxes), int)))) as pool:
            sizes = [*pool.map(ask, range(len(a.boxes)))]
        for n in sizes:
            print(f"Result size: {n}")
    else:
        for number in range(len(a.boxes)):
            print(f"Result size: {ask(number)}")


def count(spark: SparkSession, a: Arguments) -> None:
    if "random" in a.flags:
        print(stats.approx_line_count(spark, a.paths[0], seed=a.seed())[0])
    elif a.box:
        print(stats.record_count(_shapes(spark, a), a.box, a.get("boundary", "open")).first()[0])
    elif index.is_index(spark, a.paths[0]):
        print(index.read_index(spark, a.paths[0]).count())
    else:
        print(stats.line_count(spark, a.paths[0]).first()[0])


def build(spark: SparkSession, a: Arguments) -> None:
    df, kind = _shapes(spark, a), a.get("sindex", "grid")
    cells = grid = None
    if "cells-of" in a.values:
        other = index.read_index(spark, a.values["cells-of"])
        grid, cells = other.grid, other.cells()
        if kind == "grid" and grid is None:
            raise ValueError("cells-of names an index that isn't a grid")
    elif "grid" in a.values:
        n = [int(v) for v in a.values["grid"].split(",")]
        grid = Grid(a.box or stats.mbr_box(df), *n)
    elif "blocksize" in a.values:
        size = sum(f[1] for f in files_of(spark, a.paths[0]))
        box = a.box or stats.mbr_box(df)
        grid = Grid.fit(box, num_partitions(size, parse_size(a.values["blocksize"]), a.get("overhead", 0.2, float)), tuple(1 / e if e > 0 else 0.0 for e in box.extents))
    counts = grid.counts if grid is not None else None
    made = index.build_index(df, a.paths[1], kind, grid if kind == "grid" else None, cells if kind != "grid" else None, counts, a.mode)
    print(f"{made.catalog.count()} partitions, {made.count()} records")


def mbr(spark: SparkSession, a: Arguments) -> None:
    """The bounding box; with -remember it is kept in the folder, which is otherwise not touched, for the next time."""
    if index.is_index(spark, a.paths[0]):
        print(index.read_index(spark, a.paths[0]).mbr())
        return
    box = index.known_mbr(spark, a.paths[0])
    if box is None:
        box = stats.mbr_box(_shapes(spark, a))
        if box is not None and "remember" in a.flags:
            index.write_mbr(spark, a.paths[0], box)
    print(box)


def readfile(spark: SparkSession, a: Arguments) -> None:
    """The partitions of an index with their rows and bytes, or the files of a heap with their bytes and blocks."""
    if index.is_index(spark, a.paths[0]):
        found = index.read_index(spark, a.paths[0])
        print(found.kind)
        rows = found.show()
        if "offset" in a.values:
            rows = rows.where(F.col("path") == f"{index.CELL}={a.values['offset']}")
        for r in rows.toLocalIterator():
            print(*r, sep=",")
    else:
        files = files_of(spark, a.paths[0])
        print(f"heap, {len(files)} files, {sum(f[1] for f in files)} bytes, {sum(f[2] for f in files)} blocks")
        for name, size, blocks, _ in files:
            print(name, size, blocks, sep=",")


def take_sample(spark: SparkSession, a: Arguments) -> None:
    df = text.read_shapes(spark, a.paths[0], a.get("shape")) if "outshape" in a.values else text.read_lines(spark, a.paths[0])
    if "size" in a.values:
        rows = sample.sample_bytes(df, parse_size(a.values["size"]), a.seed())
    elif "ratio" in a.values:
        limit = a.get("count", 1, int)
        rows = sample.sample_ratio(df, float(a.values["ratio"]), a.seed(), limit if limit > 1 else None)
    else:
        rows = sample.sample_count(df, a.get("count", 1, int), a.seed())
    _put(convert(rows, a.get("outshape")), a)


def convert(df: DataFrame, outshape: str | None) -> DataFrame:
    """Shapes as points (centres of boxes), as boxes, or as text."""
    from tesselith.functions import geometry as G

    if outshape is None:
        return df
    boxes = range_query.is_box_table(df)
    if outshape.startswith("point"):
        return df.select(*[c.alias(n) for n, c in zip("txy", G.center())]) if boxes else df.select("t", "x", "y")
    if outshape.startswith(("rect", "prism", "box", "mbr")):
        return df.select(*[f"{n}{i}" for i in "12" for n in "txy"]) if boxes else df.select(*G.mbr_of_point())
    if outshape.startswith("text"):
        return df.select(G.to_text(df.columns).alias("value"))
    raise ValueError(f"unknown shape {outshape!r}")


def make(spark: SparkSession, a: Arguments) -> None:
    shape = a.get("shape", "point")
    shape = "box" if shape.startswith(("rect", "prism", "box")) else "datapoint" if shape.startswith("data") else "point"
    if a.box is None:
        raise ValueError("generate needs mbr:")
    kind, seed, rect = a.get("type", "uniform"), a.seed(), a.get("rectsize", 0, int) or 100
    if "size" in a.values:
        df = generate.generate_bytes(spark, parse_size(a.values["size"]), a.box, kind, shape, seed, rect)
    else:
        df = generate.generate(spark, a.get("count", 1000, int), a.box, kind, shape, seed, rect)
    if "sindex" in a.values:
        index.build_index(df, a.paths[0], a.values["sindex"], mode=a.mode)
    else:
        text.write_shapes(df, a.paths[0], a.mode)


def plot(spark: SparkSession, a: Arguments) -> None:
    """All but the last path are drawn on one view, each in its colour (color: names that of the first), into the last."""
    if a.mode == "errorifexists" and exists(spark, a.paths[-1]):
        raise FileExistsError(a.paths[-1])
    tables = [_shapes(spark, a, p) for p in a.paths[:-1]]
    grids, view, width, height = raster.joint_pixels(tables, a.get("width", 1000, int), a.get("height", 1000, int), a.box)
    first = a.get("color", "black")
    colors = [first, *[c for c in raster.COLORS if c != first]]
    image = raster.overlay(*[raster.draw(g, width, height, colors[i % len(colors)], shade="shade" in a.flags) for i, g in enumerate(grids)])
    if "borders" in a.flags:
        for p in a.paths[:-1]:
            if index.is_index(spark, p):
                image = raster.draw_borders(image, view, [Box(*r) for r in index.read_index(spark, p).catalog.select("t1", "x1", "y1", "t2", "x2", "y2").collect()])
    write_bytes(spark, a.paths[-1], raster.png(image))


def nearest(spark: SparkSession, a: Arguments) -> None:
    point = tuple(float(v) for v in a.values["point"].split(","))
    df = _shapes(spark, a).withColumn("__id", F.monotonically_increasing_id())
    _put(join.knn(df, point, a.get("k", 1, int), "__id").drop("__id"), a)


def overlap(spark: SparkSession, a: Arguments) -> None:
    _put(join.intersects_join(_shapes(spark, a, a.paths[0]), _shapes(spark, a, a.paths[1])), a, 2)


def last(spark: SparkSession, a: Arguments) -> None:
    lines = text.read_lines(spark, a.paths[0]).withColumn("__n", F.monotonically_increasing_id())
    _put(sample.tail(lines, a.get("count", 10, int), "__n").drop("__n"), a)


def shuffle(spark: SparkSession, a: Arguments) -> None:
    sample.shuffle_rows(text.read_lines(spark, a.paths[0]), a.seed()).write.mode(a.mode).text(a.paths[1])


VERBS = {"rangequery": rangequery, "count": count, "index": build, "mbr": mbr, "readfile": readfile, "sample": take_sample, "generate": make, "plot": plot, "knn": nearest, "join": overlap, "tail": last, "shuffle": shuffle}


def main(args: list[str], spark: SparkSession | None = None) -> int:
    if not args or args[0] not in VERBS:
        print(__doc__, file=sys.stderr)
        return 2
    VERBS[args[0]](spark or build_session(), Arguments.parse(args[1:]))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
