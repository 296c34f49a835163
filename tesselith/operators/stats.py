"""Bounding boxes, counts and estimates."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from statistics import NormalDist, variance

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tesselith.model import AXES, Boundary, Box
from tesselith.operators.range_query import is_box_table, range_query
from tesselith.sources.files import file_system

#: Strata of a count by samples and parts counted of each at least; pieces into which text is cut, their least and greatest
#: size, and how many are looked at to tell their files.
STRATA, LEAST, PIECES, PIECE_BYTES, LOOKUPS = 32, 8, 4000, (64 << 10, 64 << 20), 4000
#: Pieces up to which text is counted whole.
FEW_PIECES = 512


def mbr(df: DataFrame, by: str | None = None) -> DataFrame:
    """Bounding box t1..y2 of points or boxes, of all rows or per value of ``by``; nulls and NaN are passed over.

    One row with nulls for an empty df without ``by``. With Parquet input of the current version only the columns of
    the coordinates are read."""
    low, high = ("1", "2") if is_box_table(df) else ("", "")
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    aggs = [F.min(known(a + low)).alias(f"{a}1") for a in AXES] + [F.max(known(a + high)).alias(f"{a}2") for a in AXES]
    return df.groupBy(*([by] if by else [])).agg(*aggs)


def mbr_box(df: DataFrame) -> Box | None:
    """Bounding box as a literal, None if there are no coordinates."""
    r = mbr(df).first()
    return None if any(v is None for v in r) else Box(*r)


def record_count(df: DataFrame, box: Box | None = None, boundary: Boundary | str = Boundary.OPEN) -> DataFrame:
    """(cnt): number of rows, in a box if one is given."""
    if box is not None:
        return range_query(df, box, "count", boundary=boundary)
    return df.agg(F.count(F.lit(1)).alias("cnt"))


def line_count(spark: SparkSession, path: str) -> DataFrame:
    """(cnt): number of lines of text files that aren't empty."""
    return spark.read.text(path).where(F.length("value") > 0).agg(F.count(F.lit(1)).alias("cnt"))


def with_counters(df: DataFrame, name: str = "counters") -> tuple[DataFrame, Observation]:
    """df, and an observation that has the number of its rows (n_rows) after an action, without a pass of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows")), seen


def estimate(draw: Callable[[int], list[float]], value: Callable[[float], float], good: Callable[[float, float], bool], first: int = 10, most: int = 1 << 20) -> tuple[float, float]:
    """Confidence range of value(mean): draws more numbers, twice as many each time, until good(low, high) or ``most``.

    draw(n) gives up to n further numbers; fewer end the estimate. The range is that of the mean at 99 %."""
    count, mean, square, size = 0, 0.0, 0.0, first
    while True:
        fresh = draw(size)
        for v in fresh:
            count += 1
            step = v - mean
            mean += step / count
            square += step * (v - mean)
        if not count:
            raise ValueError("nothing was drawn")
        half = 2.5758 * math.sqrt(square / max(1, count - 1) / count)  # of the normal distribution, both sides 0.5 %
        ends = sorted((value(max(mean - half, math.ulp(0.0))), value(mean + half)))
        if good(*ends) or len(fresh) < size or count >= most:
            return ends[0], ends[1]
        size = count


def _stratified(count: Callable[[list[int]], list[int]], runs: list[range], confidence: float, rel_error: float, seed: int, ready: Callable[[], bool] = lambda: True) -> tuple[float, float, float]:
    """(total, low, high) over parts whose numbers count(parts) tells; runs: parts that follow each other and are alike.

    Strata are the runs, long ones cut into STRATA pieces. Each round counts further parts of each stratum in random order,
    twice as many each time; once every stratum has LEAST of them it ends when it is ready() and the interval is narrower
    than rel_error of its high end. If it never is, all parts are counted and the result is exact."""
    z, rng = NormalDist().inv_cdf((1 + confidence) / 2), np.random.default_rng(seed)
    whole = sum(map(len, runs))
    strata = [rng.permutation(s) for r in runs for s in np.array_split(np.arange(r.start, r.stop), max(1, min(len(r) // (2 * LEAST), STRATA * len(r) // max(1, whole))))]
    found: list[list[int]] = [[] for _ in strata]
    each = LEAST // 2
    while True:
        each *= 2
        wanted = [s[len(f) : each] for s, f in zip(strata, found)]
        flat = np.concatenate(wanted).tolist() if wanted else []
        fresh = iter(count(flat) if flat else [])
        for w, f in zip(wanted, found):
            f += [next(fresh) for _ in w]
        if all(len(f) == len(s) for s, f in zip(strata, found)):
            total = float(sum(map(sum, found)))
            return total, total, total
        total = sum(len(s) * sum(f) / len(f) for s, f in zip(strata, found))
        half = z * math.sqrt(sum(len(s) ** 2 * variance(f) / len(f) * (1 - len(f) / len(s)) if len(f) < len(s) else 0.0 for s, f in zip(strata, found)))
        low, high = max(total - half, float(sum(map(sum, found)))), total + half
        if ready() and high - low < rel_error * high:
            return total, low, high


def _runs(df: DataFrame, parts: int) -> list[range]:
    """Partitions of a scan of files in runs of whole pieces of one file; what is left over, pieces of different sizes, is runs as it is.

    Spark puts pieces of equal size in the order of their files, so a run is known by its ends; up to LOOKUPS are looked at."""
    held, looked = df._jdf.queryExecution().toRdd().partitions(), {}

    def piece(i: int) -> tuple:
        if i not in looked:
            files = held[i].files()
            looked[i] = (len(files), files[0].filePath().toString(), files[0].length()) if len(files) == 1 else (len(files), "", 0)
        return looked[i]

    out, todo = [], [range(parts)] if parts else []
    while todo:
        r = todo.pop()
        if len(r) == 1 or len(looked) >= LOOKUPS or (piece(r[0]) == piece(r[-1]) and piece(r[0])[0] == 1):
            out.append(r)
        else:
            middle = (r.start + r.stop) // 2
            todo += [range(middle, r.stop), range(r.start, middle)]
    joined: list[range] = []
    for r in out:
        if joined and len(looked) < LOOKUPS and piece(joined[-1][-1]) == piece(r[0]) and piece(r[0])[0] == 1:
            joined[-1] = range(joined[-1].start, r.stop)
        else:
            joined.append(r)
    return joined


def _counter(df: DataFrame) -> tuple[Callable[[list[int]], list[int]], int]:
    """A function that counts the rows of given partitions, and how many partitions there are. Only a constant per row leaves the JVM."""
    counts = df.select(F.lit(1).alias("one")).mapInArrow(_batch_rows, "n bigint").rdd
    context = df.sparkSession.sparkContext
    return lambda parts: context.runJob(counts, lambda rows: [sum(r["n"] for r in rows)], parts), counts.getNumPartitions()


def approx_line_count(spark: SparkSession, path: str, rel_error: float = 0.01, seed: int = 1, confidence: float = 0.99) -> tuple[int, int, int]:
    """(count, low, high): estimated number of non-empty lines of text files, to a relative width of ``rel_error``.

    Pieces of the files are drawn, stratified by file and place, and their lines counted as they are read: decompressed,
    whole. Files that can't be split, as those of gzip, are one piece each. Input of few pieces is counted whole, so the
    result is exact then."""
    fs, pattern = file_system(spark, path)
    size = sum(fs.getContentSummary(s.getPath()).getLength() for s in fs.globStatus(pattern) or [])
    if not size:
        return 0, 0, 0
    settings = {"spark.sql.files.maxPartitionBytes": str(min(PIECE_BYTES[1], max(PIECE_BYTES[0], size // PIECES))), "spark.sql.files.openCostInBytes": "4096"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        lines = spark.read.text(path).where(F.length("value") > 0)
        count, parts = _counter(lines)
        # Few pieces are counted whole, each as a stratum of its own.
        runs = _runs(lines, parts) if parts > FEW_PIECES else [range(i, i + 1) for i in range(parts)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    total, low, high = _stratified(count, runs, confidence, rel_error, seed)
    return round(total), math.floor(low), math.ceil(high)


def _batch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})


def approx_count_range(df: DataFrame, seconds: float = 10.0, confidence: float = 0.99, rel_error: float = 0.01, seed: int = 1) -> tuple[int, int, int]:
    """(count, low, high): the row count, exact unless it takes longer than the given time.

    Partitions are counted in rounds of random ones from all parts of the input. Once the time is over, the count ends as
    soon as its interval, at the given confidence, is narrower than rel_error of its high end; if it never is, all
    partitions are counted. An estimate of 0 is always exact."""
    began = time.monotonic()
    count, parts = _counter(df)
    total, low, high = _stratified(count, [range(parts)], confidence, rel_error, seed, lambda: time.monotonic() - began >= seconds)
    return round(total), math.floor(low), math.ceil(high)


def approx_count(df: DataFrame, seconds: float = 10.0, confidence: float = 0.99) -> int:
    """The count of approx_count_range without its interval."""
    return approx_count_range(df, seconds, confidence)[0]
