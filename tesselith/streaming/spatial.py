"""The stateless operators on streams, and counts per cell and time window with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselith.model import Boundary, Box
from tesselith.operators import grid as grids
from tesselith.operators.grid import Grid
from tesselith.operators.range_query import range_query


def shape_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream of shapes."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def range_stream(stream: DataFrame, box: Box, boundary: Boundary | str = Boundary.OPEN) -> DataFrame:
    """Rows in a box, as they arrive."""
    return range_query(stream, box, boundary=boundary)


def cell_stream(stream: DataFrame, grid: Grid) -> DataFrame:
    """Points with their cell, as they arrive."""
    return grids.assign_cells(stream, grid)


def cell_counts(stream: DataFrame, grid: Grid, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, cell_id, cnt) of points by event time t (epoch seconds). A window is final once the latest event is
    ``late`` beyond its end; rows later than that are left out, as are rows without full coordinates."""
    timed = cell_stream(stream, grid).where("cell_id is not null").withColumn("event_time", F.timestamp_micros((F.col("t") * 1_000_000).cast("bigint")))
    counted = timed.withWatermark("event_time", late).groupBy(F.window("event_time", every), "cell_id").agg(F.count(F.lit(1)).alias("cnt"))
    return counted.select(F.col("window.start").alias("window_start"), "cell_id", "cnt")


def first_arrivals(stream: DataFrame, ids: str, time: str, late: str = "2 days") -> DataFrame:
    """Each id once: rows delivered again within ``late`` of event time are dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([ids])
