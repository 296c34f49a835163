"""Raster images: pixels by aggregation, drawn and written as PNG."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselith.model import Box
from tesselith.operators.range_query import is_box_table
from tesselith.operators.stats import mbr_box
from tesselith.sources.files import write_bytes

# Colours by name.
COLORS = {"black": (0, 0, 0), "red": (255, 0, 0), "blue": (0, 0, 255), "green": (0, 255, 0), "orange": (255, 200, 0)}
#: Pixels of an image at most; they are brought to the driver.
MAX_PIXELS = 50_000_000


def fit_size(box: Box, width: int, height: int) -> tuple[int, int]:
    """Width and height with the proportions of the box: the side that is too long is shortened."""
    w, h = box.x2 - box.x1, box.y2 - box.y1
    if not w > 0 or not h > 0:
        return max(1, width), max(1, height)
    if w / h > width / height:
        return width, max(1, int(h * width / w))
    return max(1, int(w * height / h)), height


def _pixel(v: Column, low: float, high: float, size: int) -> Column:
    """Number of a pixel, cut towards zero; a dimension without extent is all at 0."""
    if not high > low:
        return F.lit(0).cast("bigint")
    return ((v - F.lit(low)) * F.lit(float(size)) / F.lit(high - low)).cast("bigint")


def pixels(df: DataFrame, width: int, height: int, box: Box | None = None) -> DataFrame:
    """(px, py, n): how many points, or outlines of boxes, cover each pixel; only pixels in use.

    box: what the image shows, by default the bounding box of df; t plays no part. What lies on the high faces or
    outside isn't drawn. Rows with null or NaN coordinates aren't drawn either; repeated rows count each time.
    """
    box = box or mbr_box(df)
    if box is None:
        return df.sparkSession.createDataFrame([], "px bigint, py bigint, n bigint")
    seen = (F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height)
    if not is_box_table(df):
        good = df.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
        # Cutting towards zero would draw what lies less than a pixel below the low faces.
        good = good.where((F.col("x") >= box.x1) & (F.col("y") >= box.y1) & (F.col("x") <= box.x2) & (F.col("y") <= box.y2))
        rows = good.select(_pixel(F.col("x"), box.x1, box.x2, width).alias("px"), _pixel(F.col("y"), box.y1, box.y2, height).alias("py"))
    else:
        good = df.where(" and ".join(f"{c} is not null and not isnan({c})" for c in ("x1", "y1", "x2", "y2")) + " and x1 <= x2 and y1 <= y2")
        good = good.where((F.col("x2") >= box.x1) & (F.col("y2") >= box.y1) & (F.col("x1") <= box.x2) & (F.col("y1") <= box.y2))
        clip = lambda c, size: F.greatest(F.lit(-1).cast("bigint"), F.least(F.lit(size).cast("bigint"), c))
        edge = good.select(
            clip(F.floor(_float(F.col("x1"), box.x1, box.x2, width)), width).alias("l"), clip(F.floor(_float(F.col("x2"), box.x1, box.x2, width)) + 1, width).alias("r"),
            clip(F.floor(_float(F.col("y1"), box.y1, box.y2, height)), height).alias("b"), clip(F.floor(_float(F.col("y2"), box.y1, box.y2, height)) + 1, height).alias("t"),
        )
        one = lambda x, y: F.struct(x.alias("px"), y.alias("py"))
        l, r, b, t = (F.col(c) for c in "lrbt")
        flat = F.concat(F.transform(F.sequence(l, r), lambda x: one(x, b)), F.transform(F.sequence(l, r), lambda x: one(x, t)))
        tall = F.concat(F.transform(F.sequence(b, t), lambda y: one(l, y)), F.transform(F.sequence(b, t), lambda y: one(r, y)))
        rows = edge.select(F.explode(F.array_distinct(F.concat(flat, tall))).alias("p")).select("p.px", "p.py")
    return rows.where(seen).groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"))


def _float(v: Column, low: float, high: float, size: int) -> Column:
    return F.lit(0.0) if not high > low else (v - F.lit(low)) * F.lit(float(size)) / F.lit(high - low)


def line_pixels(lines: DataFrame, width: int, height: int, box: Box) -> DataFrame:
    """(px, py, n): how many lines (ax, ay, bx, by) cross each pixel of a view; only pixels in use.

    A line is a run of pixels along the axis on which it is longer. Only its part within the view is walked along, however long
    it is. Lines with a null, NaN or infinite end aren't drawn; one without length is a pixel; repeated lines count each time."""
    good = F.lit(True)
    for c in ("ax", "ay", "bx", "by"):
        good &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    px = lines.where(good).select(*[_float(F.col(f"{e}{a}"), l, h, n).alias(f"{e}{a}") for e in "ab" for a, l, h, n in (("x", box.x1, box.x2, width), ("y", box.y1, box.y2, height))])
    # The shares of the way at which the line enters and leaves the view.
    enter, leave = [F.lit(0.0)], [F.lit(1.0)]
    for a, n in (("x", width), ("y", height)):
        start, way = F.col(f"a{a}"), F.col(f"b{a}") - F.col(f"a{a}")
        at = [F.when(way != 0, (F.lit(float(e)) - start) / way) for e in (0, n)]
        beside = (way == 0) & ((start < 0) | (start >= n))
        enter.append(F.when(beside, F.lit(2.0)).otherwise(F.coalesce(F.least(*at), F.lit(0.0))))
        leave.append(F.coalesce(F.greatest(*at), F.lit(1.0)))
    seen = px.withColumns({"__in": F.greatest(*enter), "__out": F.least(*leave)}).where("__in <= __out")
    long = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))) * (F.col("__out") - F.col("__in"))
    steps = seen.withColumn("__n", F.greatest(F.lit(1).cast("bigint"), 2 * F.ceil(long)))  # twice a pixel, as ends lie on their edges
    share = lambda i: F.col("__in") + (F.col("__out") - F.col("__in")) * i / F.col("__n")
    at = lambda i, a: F.floor(F.col(f"a{a}") + share(i) * (F.col(f"b{a}") - F.col(f"a{a}")))
    run = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("__n")), lambda i: F.struct(at(i, "x").alias("px"), at(i, "y").alias("py")))
    cells = steps.select(F.explode(F.array_distinct(run)).alias("p")).select("p.px", "p.py")
    return cells.where((F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height)).groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"))


def ring_pixels(regions: DataFrame, width: int, height: int, box: Box, ring: str = "ring") -> DataFrame:
    """(px, py, n) of the outlines of rings, array<struct<x, y>>; an open ring is closed."""
    points = F.col(f"`{ring}`")
    edges = F.zip_with(points, F.concat(F.slice(points, F.lit(2), F.greatest(F.lit(1), F.size(points) - 1)), F.slice(points, 1, 1)), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    lines = regions.where(points.isNotNull() & (F.size(points) > 1)).select(F.explode(edges).alias("e")).select(*[F.col(f"e.{c}").cast("double").alias(c) for c in ("ax", "ay", "bx", "by")])
    return line_pixels(lines, width, height, box)


def combine_pixels(grids: Sequence[DataFrame]) -> DataFrame:
    """Pixel grids of the same box and size laid over each other: counts add up."""
    all_ = grids[0]
    for g in grids[1:]:
        all_ = all_.unionByName(g)
    return all_.groupBy("px", "py").agg(F.sum("n").alias("n"))


def draw(grid: DataFrame, width: int, height: int, color: str | tuple[int, int, int] = "black", image: np.ndarray | None = None, shade: bool = False) -> np.ndarray:
    """RGBA image with the pixels of a grid in a colour, over ``image`` if given; shade: opacity by the logarithm of the count."""
    if width * height > MAX_PIXELS:
        raise ValueError(f"an image has at most {MAX_PIXELS} pixels")
    rgb = COLORS[color] if isinstance(color, str) else color
    out = np.zeros((height, width, 4), dtype="uint8") if image is None else image.copy()
    got = grid.toPandas()
    if len(got):
        n = got["n"].to_numpy(float)
        alpha = np.full(len(n), 255) if not shade else (55 + 200 * np.log1p(n) / np.log1p(n.max())).astype(int)
        out[got["py"].to_numpy(int), got["px"].to_numpy(int)] = np.column_stack([np.tile(rgb, (len(n), 1)), alpha])
    return out


def overlay(*images: np.ndarray) -> np.ndarray:
    """Images of one size over each other, later ones on top, by opacity."""
    out = images[0].astype(float)
    for top in images[1:]:
        a = top[..., 3:].astype(float) / 255
        out[..., :3] = top[..., :3] * a + out[..., :3] * (1 - a)
        out[..., 3:] = 255 * (a + out[..., 3:] / 255 * (1 - a))
    return out.round().astype("uint8")


def draw_borders(image: np.ndarray, view: Box, cells: Sequence[Box], color: str | tuple[int, int, int] = "red") -> np.ndarray:
    """Image with the outlines of cells."""
    rgb = COLORS[color] if isinstance(color, str) else color
    height, width = image.shape[:2]
    out = image.copy()
    at = lambda v, lo, hi, n: int(min(max((v - lo) * n / (hi - lo), 0), n - 1)) if hi > lo else 0
    for c in cells:
        l, r = at(c.x1, view.x1, view.x2, width), at(c.x2, view.x1, view.x2, width)
        b, t = at(c.y1, view.y1, view.y2, height), at(c.y2, view.y1, view.y2, height)
        out[[b, t], l : r + 1] = out[b : t + 1, [l, r]] = (*rgb, 255)
    return out


def png(image: np.ndarray) -> bytes:
    """RGBA image as PNG; row 0 is at the top."""
    height, width = image.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((height, 1), dtype="uint8"), image.reshape(height, width * 4)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def joint_pixels(tables: Sequence[DataFrame], width: int, height: int, box: Box | None = None) -> tuple[list[DataFrame], Box, int, int]:
    """Pixel grids of several tables on one view, by default the box around all of them, and the view with its size in proportion."""
    if box is None:
        around = [b for b in map(mbr_box, tables) if b is not None]
        if not around:
            raise ValueError("nothing to draw")
        box = reduce(Box.union, around)
    width, height = fit_size(box, width, height)
    return [pixels(t, width, height, box) for t in tables], box, width, height


def combine_tables(tables: Sequence[DataFrame], width: int = 1000, height: int = 1000, colors: Sequence[str] = tuple(COLORS), box: Box | None = None) -> np.ndarray:
    """One image of tables with different extents, later ones on top, each in its colour."""
    grids, _, width, height = joint_pixels(tables, width, height, box)
    return overlay(*[draw(g, width, height, colors[i % len(colors)]) for i, g in enumerate(grids)])


def plot_png(df: DataFrame, path: str, width: int = 1000, height: int = 1000, color: str = "black", box: Box | None = None, shade: bool = False) -> tuple[int, int]:
    """Draws points or boxes to a PNG file, on any file system, in the proportions of their bounding box; returns its size."""
    (grid,), _, width, height = joint_pixels([df], width, height, box)
    write_bytes(df.sparkSession, path, png(draw(grid, width, height, color, shade=shade)))
    return width, height
