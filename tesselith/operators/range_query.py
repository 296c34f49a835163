"""Box range queries: rows, distinct values, distribution, average and count, for one box or many."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselith.functions import geometry as G
from tesselith.model import Boundary, Box, Kind


def is_box_table(df: DataFrame) -> bool:
    return "t1" in df.columns and "t" not in df.columns


def _inside(df: DataFrame, box: Box | str, boundary: Boundary | str) -> Column:
    return G.intersects("", box) if is_box_table(df) else G.within(box, boundary)


def _result(rows: DataFrame, kind: Kind, field: str | None, by: list[str]) -> DataFrame:
    if kind is Kind.GET:
        return rows
    if kind is Kind.COUNT:
        return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("cnt"))
    if not field:
        raise ValueError(f"{kind.value} needs a field")
    value = F.col(f"`{field}`")
    if kind is Kind.DISTINCT:
        return rows.select(*by, value).distinct()
    if kind is Kind.DISTRIBUTION:
        return rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("cnt"))
    return rows.groupBy(*by).agg(F.avg(value).alias("average"))


def result_of(rows: DataFrame, kind: Kind | str, field: str | None = None) -> DataFrame:
    """What range_query returns, of rows that are known to be in the box."""
    return _result(rows, Kind(kind), field, [])


def range_query(df: DataFrame, box: Box, kind: Kind | str = Kind.GET, field: str | None = None, boundary: Boundary | str = Boundary.OPEN) -> DataFrame:
    """Rows of df in a box, or an aggregate of one of their fields.

    df has points (t, x, y) or boxes (t1..y2) and any further columns. Points follow ``boundary``, boxes must overlap
    openly, so a box without extent is in the query only if it lies inside. get: the rows; distinct: (field);
    distribution: (field, cnt); average: (average), null without values; count: (cnt). Rows with a null or NaN coordinate
    are in no box; repeated rows stay repeated; null field values are values, but not of the average. The order of the
    rows isn't defined. An inverted box or one with NaN contains nothing.
    """
    return _result(df.where(_inside(df, box, boundary)), Kind(kind), field, [])


def range_query_many(df: DataFrame, boxes: Sequence[Box], kind: Kind | str = Kind.GET, field: str | None = None, boundary: Boundary | str = Boundary.OPEN) -> DataFrame:
    """range_query for each of several literal boxes, told by range_id (from 0). Boxes that nothing is in have no row.

    The rows in the bounding box of all are read once, and each row lists the boxes it is in; no join takes place. This
    is for some dozens of boxes; a table of them goes through join.point_in_box_join or join.intersects_join."""
    boxes = list(boxes)
    usable = [b for b in boxes if b.valid()]
    if not usable:
        none = df.where(F.lit(False)).withColumn("range_id", F.lit(0))
        return _result(none.select("range_id", *[F.col(f"`{c}`") for c in df.columns if c != "range_id"]), Kind(kind), field, ["range_id"])
    around = usable[0]
    for b in usable[1:]:
        around = around.union(b)
    # A box that is a row must overlap, a point mustn't be on an outer face that counts.
    rows = df.where(_inside(df, around, boundary))
    hits = F.filter(F.array(*[F.when(_inside(df, b, boundary), F.lit(i)) for i, b in enumerate(boxes)]), lambda i: i.isNotNull())
    kept = [F.col(f"`{c}`") for c in df.columns if c != "range_id"]
    return _result(rows.select(F.explode(hits).alias("range_id"), *kept), Kind(kind), field, ["range_id"])
