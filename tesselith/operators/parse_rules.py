"""Delimited text lines with typed cells: loadable rows and the rest with reasons.

A line is split into cells; the cells are exploded into (row, column, value), joined with a rule table that holds one
row per check, and evaluated; violations are aggregated per row, and the loadable rows are what an anti-join with
them leaves. Everything runs as built-in expressions; only violations shuffle for the aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns of the text format.
FIELD = r'"[^"]*+(?:""[^"]*+)*+"|[^",]*+'
QUOTED_LINE = rf"\A(?:{FIELD})(?:,(?:{FIELD}))*+\z"
NUMBER = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"

BOX_COLUMNS = ("t1", "x1", "y1", "t2", "x2", "y2")
BOX_ORDER = (("t1", "t2"), ("x1", "x2"), ("y1", "y2"))


@dataclass(frozen=True)
class LineFormat:
    """Columns of doubles, and pairs (low, high) of them that must not be out of order."""

    columns: tuple[str, ...] = BOX_COLUMNS
    ordered: tuple[tuple[str, str], ...] = BOX_ORDER


def rule_table(spark: SparkSession, fmt: LineFormat) -> DataFrame:
    """One row per check: column number (0: the line), kind, number of the other column, reason. Its size is the format's."""
    rows = [
        (0, "null_line", 0, "line is null"),
        (0, "quoting", 0, "broken quoting"),
        (0, "field_count", 0, f"not {len(fmt.columns)} fields"),
    ]
    for i, name in enumerate(fmt.columns, 1):
        rows += [(i, "number", 0, f"{name} is not a number"), (i, "finite", 0, f"{name} is not finite")]
    for low, high in fmt.ordered:
        rows.append((fmt.columns.index(high) + 1, "order", fmt.columns.index(low) + 1, f"{low} > {high}"))
    return spark.createDataFrame(rows, "__rule_col int, __kind string, __other int, __reason string")


def _split(line: Column, fmt: LineFormat) -> tuple[Column, Column]:
    """Whether the line's quoting is sound, and its cells as array<struct<text, num>>; the cells are null if it isn't or there is another number of them."""
    bare = F.when(line.endswith("\r"), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    # Without a quote the line is sound and its commas part the cells; that spares the patterns.
    quoted = bare.contains('"')
    sound = ~quoted | bare.rlike(QUOTED_LINE)
    raw = F.when(~quoted, F.split(bare, ",", -1)).when(sound, F.regexp_extract_all(F.concat(F.lit(","), bare), F.lit(f",({FIELD})"), F.lit(1)))
    return sound, raw


def _cell(raw: Column) -> Column:
    inner = F.when(raw.startswith('"'), F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))).otherwise(raw)
    text = F.btrim(inner, F.lit(" \t"))
    return F.struct(text.alias("text"), F.when(text.rlike(NUMBER), text.try_cast("double")).alias("num"))


def _parsed(df: DataFrame, line: str, keep: Sequence[str], fmt: LineFormat) -> DataFrame:
    """keep columns, the line as __line, __sound, __n (number of cells) and __cells."""
    base = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{line}`").alias("__line"))
    sound, raw = _split(F.col("__line"), fmt)
    base = base.withColumns({"__sound": sound, "__raw": raw}).withColumn("__n", F.size("__raw"))
    cells = F.when(F.col("__n") == len(fmt.columns), F.transform("__raw", _cell))
    return base.withColumn("__cells", cells).drop("__raw")


def explode_cells(df: DataFrame, line: str, keep: Sequence[str] = (), fmt: LineFormat = LineFormat()) -> DataFrame:
    """Rows (keep..., __line, __sound, __n, __cells, __col, __value): column 0 is the whole line, the others are cells."""
    parsed = _parsed(df, line, keep, fmt)
    numbered = F.transform("__cells", lambda c, i: F.struct((i + 1).alias("col"), c.alias("value")))
    whole = F.array(F.struct(F.lit(0).alias("col"), F.lit(None).cast("struct<text:string,num:double>").alias("value")))
    exploded = parsed.withColumn("__e", F.explode(F.concat(whole, F.coalesce(numbered, F.array().cast("array<struct<col:int,value:struct<text:string,num:double>>>")))))
    return exploded.withColumns({"__col": F.col("__e.col"), "__value": F.col("__e.value")}).drop("__e")


def violations(df: DataFrame, line: str, keep: Sequence[str] = (), fmt: LineFormat = LineFormat()) -> DataFrame:
    """Rows (keep..., __line, __rule_col, __reason), one per violated rule."""
    cells = explode_cells(df, line, keep, fmt)
    rules = F.broadcast(rule_table(df.sparkSession, fmt))  # as many rows as the format has checks
    joined = cells.join(rules, F.col("__col") == F.col("__rule_col"))
    num, finite = F.col("__value.num"), lambda n: n.isNotNull() & (F.abs(n) < float("inf"))
    peer = F.element_at("__cells", F.when(F.col("__other") > 0, F.col("__other")).otherwise(1))["num"]
    kind = F.col("__kind")
    broken = (
        F.when(kind == "null_line", F.col("__line").isNull())
        .when(kind == "quoting", F.col("__line").isNotNull() & ~F.col("__sound"))
        .when(kind == "field_count", F.col("__sound") & (F.col("__n") != len(fmt.columns)))
        .when(kind == "number", num.isNull())
        .when(kind == "finite", num.isNotNull() & ~finite(num))
        .when(kind == "order", finite(num) & finite(peer) & (peer > num))
    )
    return joined.where(F.coalesce(broken, F.lit(False))).select(*[F.col(f"`{c}`") for c in keep], "__line", "__rule_col", "__reason")


def rejected(df: DataFrame, line: str, keep: Sequence[str] = (), fmt: LineFormat = LineFormat()) -> DataFrame:
    """Lines that can't be loaded: (keep..., raw_line, reasons array<string>), reasons in the order of the columns.

    Rows that agree in the kept columns and the line are one row here, as their verdicts agree. A null line is
    rejected, an empty one too (it has one field); null keys stay null. Further columns of df play no part. An empty
    df gives an empty result.
    """
    found = violations(df, line, keep, fmt)
    return (
        found.groupBy(*[F.col(f"`{c}`") for c in keep], "__line")
        .agg(F.sort_array(F.collect_set(F.struct("__rule_col", "__reason"))).alias("__r"))
        .select(*[F.col(f"`{c}`") for c in keep], F.col("__line").alias("raw_line"), F.col("__r.__reason").alias("reasons"))
    )


def loaded(df: DataFrame, line: str, keep: Sequence[str] = (), fmt: LineFormat = LineFormat()) -> DataFrame:
    """Loadable lines: (keep..., one double per column of the format); repeated rows stay repeated.

    The rows left by an anti-join with the rejected ones on the kept columns and the line, nulls equal to nulls.
    A kept column may not have the name of a column of the format.
    """
    clash = set(keep) & set(fmt.columns)
    if clash:
        raise ValueError(f"kept columns have names of the format's: {sorted(clash)}")
    bad = rejected(df, line, keep, fmt)
    bad = bad.select(*[F.col(f"`{c}`").alias(f"__b{i}") for i, c in enumerate(keep)], F.col("raw_line").alias("__bl"))
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{line}`").alias("__line"))
    same = F.col("__line").eqNullSafe(F.col("__bl"))
    for i, c in enumerate(keep):
        same &= F.col(f"`{c}`").eqNullSafe(F.col(f"__b{i}"))
    clean = _parsed(rows.join(bad, same, "left_anti"), "__line", keep, fmt)
    return clean.select(*[F.col(f"`{c}`") for c in keep], *[F.element_at("__cells", i)["num"].alias(c) for i, c in enumerate(fmt.columns, 1)])


def reason_counts(df: DataFrame, line: str, keep: Sequence[str] = (), by: Sequence[str] = (), fmt: LineFormat = LineFormat()) -> DataFrame:
    """(by..., reason, n_lines): how many distinct rejected lines have each reason; by must be among keep."""
    return (
        rejected(df, line, keep, fmt)
        .select(*by, F.explode("reasons").alias("reason"))
        .groupBy(*by, "reason")
        .agg(F.count(F.lit(1)).alias("n_lines"))
    )
