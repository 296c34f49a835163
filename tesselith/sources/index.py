"""Space-partitioned datasets on Parquet, with a catalogue that tells which partitions a query needs.

Layout: one directory per cell (index_cell=...), rows sorted by t, x, y so that row-group statistics prune further;
_catalog holds one row per cell, _meta.json the kind. Kinds: grid (uniform cells, boxes replicated to all cells they
overlap), rtree (cells of nearly equal numbers, nothing replicated, catalogue boxes are those of the content) and
r+tree (such cells with boxes replicated, catalogue boxes are the common part of cell and content).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselith.functions import geometry as G
from tesselith.model import AXES, HIGHS, LOWS, Boundary, Box, Kind
from tesselith.operators import grid as grids
from tesselith.operators import join, range_query, stats
from tesselith.operators.grid import Grid, num_partitions
from tesselith.session import cut
from tesselith.sources.files import exists, file_system, files_of, read_file, write_text

KINDS = {"grid": True, "rtree": False, "r+tree": True}  # whether boxes are replicated
#: The column with a row's cell, by which the data lie in folders.
CELL = "index_cell"
#: Rows of a task that writes a cell, a cell with more is written by several tasks; bytes of rows in a cell by default.
FILE_ROWS, BLOCK_BYTES = 2_000_000, 128 << 20
#: Cells up to which a pruned scan lists them; more are filtered by a join.
LISTED = 1000


def _in_cells(df: DataFrame, cells: DataFrame, replicate: bool) -> DataFrame:
    """df with index_cell by a table of cells that tile all of space; its size is that of the catalogue.

    Points and centres go to the cell with low <= v < high, replicated boxes to all they overlap. The outer faces are
    infinite, so they are put a little beyond the data for the join on cells."""
    box = range_query.is_box_table(df)
    around = stats.mbr_box(df)
    if around is None:
        return df.withColumn(CELL, F.lit(None).cast("bigint"))
    bounded = cells
    for a, l, h in zip(AXES, around.low, around.high):
        room = (h - l) + abs(l) * 1e-6 + abs(h) * 1e-6 + 1.0
        bounded = bounded.withColumn(f"{a}1", F.greatest(F.col(f"{a}1"), F.lit(l - room))).withColumn(f"{a}2", F.least(F.col(f"{a}2"), F.lit(h + room)))
    bounded = bounded.select(F.col("cell_id").alias("__cell"), *LOWS, *HIGHS)
    if box and replicate:
        # A box without extent in a dimension is in the cell that holds it there: it gets the least extent there is.
        least = lambda a: F.col(f"{a}1") + F.abs(F.col(f"{a}1")) * 4e-16 + F.lit(5e-324)
        own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *LOWS, *[F.greatest(F.col(f"{a}2"), least(a)).alias(f"{a}2") for a in AXES])
        pairs = join.intersects_join(own, bounded)
        return pairs.select(*[F.col(f"a_row.`{c}`").alias(c) for c in df.columns], F.col("b___cell").alias(CELL))
    middle = [F.col(a) for a in AXES] if not box else G.center()
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(a) for a, c in zip(AXES, middle)])
    pairs = join.point_in_box_join(own, bounded, Boundary.HALF_OPEN)
    return pairs.select(*[F.col(f"p_row.`{c}`").alias(c) for c in df.columns], F.col("b___cell").alias(CELL))


def _size_of(rows: DataFrame, n: int) -> int:
    """Bytes of rows, by those of some thousand of them in columns."""
    few = rows.sample(False, min(1.0, 5000 / max(1, n)), 1).limit(5000).toArrow()
    return int(few.nbytes / max(1, few.num_rows) * n)


def _in_slabs(df: DataFrame, slabs: grids.Slabs, replicate: bool) -> DataFrame:
    """df with index_cell by binary search in the slabs' cuts, which are broadcast: a few numbers for each cell."""
    cuts = df.sparkSession.sparkContext.broadcast(slabs)
    if range_query.is_box_table(df) and replicate:

        @F.pandas_udf("array<bigint>")
        def cells(t1: pd.Series, x1: pd.Series, y1: pd.Series, t2: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
            row, cell = cuts.value.cells_of(np.column_stack([t1, x1, y1]), np.column_stack([t2, x2, y2]))
            return pd.Series(np.split(cell, np.cumsum(np.bincount(row, minlength=len(t1)))[:-1]))

        return df.withColumn(CELL, F.explode(cells(*LOWS, *HIGHS)))

    @F.pandas_udf("bigint")
    def cell(t: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(cuts.value.cell_of(np.column_stack([t, x, y])))

    return df.withColumn(CELL, cell(*(G.center() if range_query.is_box_table(df) else AXES)))


def _split(placed: DataFrame, sampled: DataFrame, share: float, file_rows: int) -> DataFrame:
    """placed with __s, the part of its cell that a row is written in: cells that the sampled rows (a share of all) say may
    hold more than file_rows are split evenly. A row's part is its place among the task's rows in the order of a hash, so
    copies are spread, and a task that runs again gives equal rows the same parts."""
    n = F.col("n")
    most = F.ceil((n + 4 * F.sqrt("n") + 8) / F.lit(share)) if share < 1 else n
    counts = sampled.groupBy(CELL).agg(F.count(F.lit(1)).alias("n"))
    many = counts.select(CELL, F.ceil(most / file_rows).cast("bigint").alias("__parts")).where("__parts > 1").toPandas()  # a sampled row each at most
    if not len(many):
        return placed.withColumn("__s", F.lit(0))
    hashable = [F.col(f"`{f.name}`") for f in placed.schema if f.dataType.typeName() not in ("map", "variant")]
    table = F.broadcast(placed.sparkSession.createDataFrame(many, f"{CELL} bigint, __parts bigint"))
    sorted_ = placed.withColumn("__h", F.xxhash64(*hashable)).sortWithinPartitions("__h").withColumn("__at", F.monotonically_increasing_id())
    return sorted_.join(table, CELL, "left").withColumn("__s", F.coalesce(F.pmod("__at", "__parts"), F.lit(0).cast("bigint"))).drop("__h", "__at", "__parts")


def build_index(df: DataFrame, path: str, kind: str = "grid", grid: Grid | None = None, cells: DataFrame | None = None, counts: tuple[int, int, int] | None = None, mode: str = "errorifexists", file_rows: int = FILE_ROWS, block: int = BLOCK_BYTES) -> "Index":
    """Writes points or boxes (and any further columns) as an index and returns it.

    grid: cells of a grid index, by default a fit of the bounding box, each dimension in units of its extent. cells: a
    table of cells (cell_id, t1..y2) for the other kinds, e.g. those of another index; by default slabs of nearly equal
    numbers of rows, cut on a bounded sample, counts = (nt, nx, ny) of them. Without grid, cells and counts there are as
    many cells as blocks of ``block`` bytes in the data. Rows without full coordinates have no place and are left out;
    inverted boxes too. A cell with many rows is written by several tasks, in files of at most file_rows. mode:
    errorifexists or overwrite. The index is written beside its path and then takes its place, so it may be built from
    rows that it replaces, and a failure leaves the old one.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown index {kind!r}")
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    if CELL in df.columns:
        raise ValueError(f"{CELL} is the name of the column that holds a row's cell")
    spark = df.sparkSession
    if mode == "errorifexists" and exists(spark, path):
        raise FileExistsError(path)
    box = range_query.is_box_table(df)
    names = [*LOWS, *HIGHS] if box else list(AXES)
    rows = df.where(" and ".join(f"{n} is not null and not isnan({n})" for n in names))
    if box:
        rows = rows.where("t1 <= t2 and x1 <= x2 and y1 <= y2")
    n = rows.count()
    wanted = num_partitions(_size_of(rows, n), block) if grid is None and cells is None and counts is None else 1
    meta: dict = {"kind": kind, "box": box, "grid": None, "schema": df.schema.jsonValue()}
    if kind == "grid":
        if grid is None:
            around = stats.mbr_box(rows) or Box(0, 0, 0, 1, 1, 1)
            grid = Grid.fit(around, wanted, tuple(1 / e if e > 0 else 0.0 for e in around.extents))
        meta["grid"] = [*grid.box.low, *grid.box.high, *grid.counts]
        place = lambda d: d.withColumn(CELL, F.explode(grid.cells_of_box()) if box else grid.cell_of(*[F.col(a) for a in AXES]))
        cell_table = grid.cells(spark)
    elif cells is not None:
        cell_table = cut(cells)
        place = lambda d: _in_cells(d, cell_table, KINDS[kind])
    else:
        slabs = grids.slabs_of(rows, counts or Grid.fit(Box(0, 0, 0, 1, 1, 1), wanted).counts)
        place = lambda d: _in_slabs(d, slabs, KINDS[kind])
        cell_table = slabs.table(spark)
    share = min(1.0, max(grids.LEAST_SAMPLED, 100 * n / file_rows) / max(1, n))
    order = [F.col(c) for c in names[:3]]
    split = _split(place(rows), place(rows.select(*names) if share == 1 else rows.select(*names).sample(False, share, 1)), share, file_rows)
    fresh = f"{path}.new-{uuid.uuid4().hex[:12]}"
    (split.repartition(CELL, "__s").sortWithinPartitions(CELL, *order).drop("__s")
     .write.partitionBy(CELL).option("maxRecordsPerFile", file_rows).parquet(fresh))
    _write_catalog(spark, fresh, cell_table, kind, box)
    write_text(spark, f"{fresh}/_meta.json", json.dumps(meta))
    _swap(spark, fresh, path, mode)
    return read_index(spark, path)


def _swap(spark: SparkSession, fresh: str, path: str, mode: str) -> None:
    """Gives a complete folder its name; what had it before is removed afterwards."""
    fs, new = file_system(spark, fresh)
    old, gone = file_system(spark, path)[1], file_system(spark, f"{path}.old-{uuid.uuid4().hex[:12]}")[1]
    there = fs.exists(old)
    if there and mode == "errorifexists":
        fs.delete(new, True)
        raise FileExistsError(path)
    if there and not fs.rename(old, gone):
        raise OSError(f"can't move {path}")
    if not fs.rename(new, old):
        raise OSError(f"can't name {path}")
    if there:
        fs.delete(gone, True)


def _write_catalog(spark: SparkSession, path: str, cells: DataFrame, kind: str, box: bool) -> None:
    low, high = (LOWS, HIGHS) if box else (AXES, AXES)
    data = _data(spark, path)
    if data is None:
        content = spark.createDataFrame([], "cell_id bigint, n bigint, m_t1 double, m_x1 double, m_y1 double, m_t2 double, m_x2 double, m_y2 double")
    else:
        content = data.groupBy(F.col(CELL).alias("cell_id")).agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(f"m_{d}") for c, d in zip(low, LOWS)], *[F.max(c).alias(f"m_{d}") for c, d in zip(high, HIGHS)])
    both = content.join(cells, "cell_id")
    if kind == "grid":
        box_of = [F.col(c) for c in (*LOWS, *HIGHS)]
    elif kind == "rtree":
        box_of = [F.col(f"m_{c}").alias(c) for c in (*LOWS, *HIGHS)]
    else:
        box_of = [F.greatest(F.col(c), F.col(f"m_{c}")).alias(c) for c in LOWS] + [F.least(F.col(c), F.col(f"m_{c}")).alias(c) for c in HIGHS]
    path_of = F.concat(F.lit(f"{CELL}="), F.col("cell_id").cast("string")).alias("path")
    # The cell itself, as c_..., serves the reference-point rule; the content box serves pruning and the bounding box.
    both.select("cell_id", path_of, *box_of, "n", *[f"m_{c}" for c in (*LOWS, *HIGHS)], *[F.col(c).alias(f"c_{c}") for c in (*LOWS, *HIGHS)]).coalesce(1).write.parquet(f"{path}/_catalog")


def _data(spark: SparkSession, path: str) -> DataFrame | None:
    fs, p = file_system(spark, path)
    if not any(s.getPath().getName().startswith(f"{CELL}=") for s in fs.listStatus(p)):
        return None
    rows = spark.read.parquet(path)
    return rows.withColumn(CELL, F.col(CELL).cast("bigint"))


def read_index(spark: SparkSession, path: str) -> "Index":
    if not exists(spark, f"{path}/_meta.json"):
        raise FileNotFoundError(f"no index at {path}")
    meta = json.loads(read_file(spark, f"{path}/_meta.json"))
    g = meta["grid"]
    grid = Grid(Box(*g[:6]), *map(int, g[6:])) if g else None
    return Index(spark, path, meta["kind"], meta["box"], grid, T.StructType.fromJson(meta["schema"]))


def is_index(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/_meta.json")


def prune(catalog: DataFrame, box: Box) -> DataFrame:
    """Catalogue rows whose content touches a box; the faces count, so no rule of boundaries loses rows."""
    return catalog.where(" and ".join(f"m_{l} <= {float(h)!r}D and m_{u} >= {float(b)!r}D" for l, u, b, h in zip(LOWS, HIGHS, box.low, box.high)))


def prune_by(catalog: DataFrame, wanted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Catalogue rows picked by any function of the catalogue; None of it means all."""
    return wanted(catalog)


def prune_pairs(a: "Index", b: "Index", wanted: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(a_cell_id, b_cell_id) of the partitions of two indexes whose contents may hold overlapping rows, and that
    ``wanted`` keeps of them."""
    touch = lambda c: c.select("cell_id", *[F.col(f"m_{n}").alias(n) for n in LOWS], *[(F.col(f"m_{n}") + F.abs(F.col(f"m_{n}")) * 4e-16 + F.lit(5e-324)).alias(n) for n in HIGHS])
    pairs = join.intersects_join(touch(a.catalog), touch(b.catalog)).select("a_cell_id", "b_cell_id")
    return wanted(pairs) if wanted else pairs


def block_pairs(a: "Index", b: "Index", bound: int = 1_000_000) -> DataFrame:
    """(a_cell_id, b_cell_id): all pairs of the partitions of two indexes, whether they have anything in common or not; for
    up to ``bound`` pairs. prune_pairs finds those that matter, however many partitions there are."""
    ids = [[r[0] for r in i.catalog.select("cell_id").limit(bound + 1).collect()] for i in (a, b)]
    if len(ids[0]) * len(ids[1]) > bound:
        raise ValueError(f"more than {bound} pairs; prune_pairs has no bound")
    return a.spark.createDataFrame([(x, y) for x in ids[0] for y in ids[1]], "a_cell_id bigint, b_cell_id bigint")


def merged(boxes: Sequence[Box]) -> list[Box]:
    """Boxes that don't overlap each other and cover the given ones: overlapping ones are replaced by the box around them."""
    done: list[Box] = []
    for box in boxes:
        while (hit := [d for d in done if d.overlaps(box)]):
            done = [d for d in done if d not in hit]
            for d in hit:
                box = box.union(d)
        done.append(box)
    return done


def write_mbr(spark: SparkSession, path: str, box: Box) -> None:
    """Remembers the bounding box of the files of a folder in a hidden file of it, for known_mbr; never done unless asked for."""
    write_text(spark, f"{path}/_mbr.json", json.dumps({"box": [*box.low, *box.high], "files": files_of(spark, path)}))


def known_mbr(spark: SparkSession, path: str) -> Box | None:
    """The remembered bounding box of a folder, None if there is none or a file has come, gone or changed since."""
    if not exists(spark, f"{path}/_mbr.json"):
        return None
    kept = json.loads(read_file(spark, f"{path}/_mbr.json"))
    return Box(*kept["box"]) if kept["files"] == [list(f) for f in files_of(spark, path)] else None


def catalog_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_cell_id, b_cell_id) of partitions whose boxes overlap openly."""
    cols = ["cell_id", *LOWS, *HIGHS]
    return join.intersects_join(a.select(*cols), b.select(*cols)).select("a_cell_id", "b_cell_id")


@dataclass
class Index:
    """A dataset written by build_index."""

    spark: SparkSession
    path: str
    kind: str
    box: bool
    grid: Grid | None
    schema: T.StructType

    @property
    def replicated(self) -> bool:
        return KINDS[self.kind] and self.box

    @property
    def compact(self) -> bool:
        return self.kind != "grid"

    @property
    def catalog(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/_catalog")

    @property
    def stored(self) -> DataFrame:
        """All stored rows with index_cell; of replicated boxes, every copy."""
        rows = _data(self.spark, self.path)
        return self._none() if rows is None else rows

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField(CELL, T.LongType())]))

    def cells(self) -> DataFrame:
        """(cell_id, t1..y2) of the cells."""
        return self.catalog.select("cell_id", *[F.col(f"c_{c}").alias(c) for c in (*LOWS, *HIGHS)])

    def areas(self) -> DataFrame:
        """(cell_id, t1..y2): the boxes of the partitions, numbered from 1, overlapping ones united to the box around them."""
        boxes = [Box(*r) for r in self.catalog.orderBy("cell_id").select(*LOWS, *HIGHS).collect()]  # a row a partition
        return self.spark.createDataFrame([(i, *b.low, *b.high) for i, b in enumerate(merged(boxes), 1)], "cell_id bigint, " + ", ".join(f"{c} double" for c in (*LOWS, *HIGHS)))

    def show(self) -> DataFrame:
        """(path, t1..y2, n, bytes): one row per partition, with the length of its files."""
        sizes: dict[str, int] = {}
        for name, size, _, _ in files_of(self.spark, self.path):
            sizes[name.split("/")[0]] = sizes.get(name.split("/")[0], 0) + size
        lengths = self.spark.createDataFrame([*sizes.items()], "path string, bytes bigint")
        return self.catalog.select("path", *LOWS, *HIGHS, "n").join(F.broadcast(lengths), "path", "left").orderBy("path")

    def mbr(self) -> Box | None:
        """Bounding box from the catalogue alone."""
        r = self.catalog.agg(*[F.min(f"m_{c}") for c in LOWS], *[F.max(f"m_{c}") for c in HIGHS]).first()
        return None if r[0] is None else Box(*r)

    def count(self) -> int:
        """Stored rows, from the catalogue alone."""
        return self.catalog.agg(F.sum("n")).first()[0] or 0

    def scan(self, box: Box) -> DataFrame:
        """Stored rows of the partitions that a box touches."""
        hit = prune(self.catalog, box).select("cell_id")
        ids = [r[0] for r in hit.limit(LISTED + 1).collect()]
        if not ids:
            return self._none()
        rows = self.spark.read.parquet(self.path)
        hit = hit.withColumnRenamed("cell_id", CELL)
        rows = rows.where(F.col(CELL).isin(ids)) if len(ids) <= LISTED else rows.join(hit, CELL, "left_semi")
        return rows.withColumn(CELL, F.col(CELL).cast("bigint"))

    def _reported(self, query: Box) -> Column:
        """Of the copies of a replicated box, the one in the cell with the low corner of the common part."""
        if self.grid is not None:
            return grids.reference_cell(self.grid, query, CELL)
        corner = [F.greatest(F.lit(q), F.col(f"{a}1")) for q, a in zip(query.low, AXES)]
        inside = F.lit(True)
        for v, a in zip(corner, AXES):
            inside &= (v >= F.col(f"c_{a}1")) & (v < F.col(f"c_{a}2"))
        return inside

    def range_query(self, box: Box, kind: Kind | str = Kind.GET, field: str | None = None, boundary: Boundary | str = Boundary.OPEN) -> DataFrame:
        """As range_query over the rows the index was built from, reading only partitions that the box touches."""
        rows = self.scan(box)
        if self.replicated:
            if self.grid is None:
                rows = rows.join(prune(self.catalog, box).select(F.col("cell_id").alias(CELL), *[f"c_{c}" for c in (*LOWS, *HIGHS)]), CELL)
            rows = rows.where(self._reported(box)).drop(*[f"c_{c}" for c in (*LOWS, *HIGHS)])
        return range_query.range_query(rows.drop(CELL), box, kind, field, boundary)
