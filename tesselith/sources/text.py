"""Text files of shapes, raw lines, legacy catalogues and key-value output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselith.model import PARTITION, infer_shape, shape_schema


def read_shapes(spark: SparkSession, path: str | list[str], shape: str | T.StructType | None = None, extra: T.StructType | None = None) -> DataFrame:
    """Shapes of comma-separated files, one per line without header; compressed by extension. shape: a name, a schema, or
    None to tell it from the first line. extra: further columns after the shape's. A cell that can't be read is null."""
    schema = shape if isinstance(shape, T.StructType) else shape_schema(shape) if shape else infer_shape((spark.read.text(path).where("length(value) > 0").first() or ("",))[0])
    if extra:
        schema = T.StructType([*schema.fields, *extra.fields])
    return spark.read.schema(schema).csv(path, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value): raw lines, empty ones left out."""
    return spark.read.text(path).where(F.length("value") > 0)


def write_shapes(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
    """Rows as comma-separated lines without header; nulls are empty."""
    df.write.mode(mode).csv(path, compression=compression, nullValue="", emptyValue="")


def write_pairs(df: DataFrame, path: str, key: str | None, value: str | None, sep: str = "\t", mode: str = "errorifexists", compression: str = "none") -> None:
    """Lines of key, separator and value; a null side and the separator are left out, a row with both null writes nothing."""
    k = F.col(f"`{key}`").cast("string") if key else F.lit(None).cast("string")
    v = F.col(f"`{value}`").cast("string") if value else F.lit(None).cast("string")
    lines = df.select(F.when(k.isNull(), v).when(v.isNull(), k).otherwise(F.concat(k, F.lit(sep), v)).alias("value"))
    lines.where("value is not null").write.mode(mode).text(path, compression=compression)


def read_master(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """Kind and partitions (t1..y2, filename) of a legacy catalogue file _master.grid, _master.rtree or _master.r+tree."""
    kind = path.rsplit("_master.", 1)[-1]
    if kind not in ("grid", "rtree", "r+tree"):
        raise ValueError(f"unknown catalogue {path!r}")
    from tesselith.sources.files import read_file

    rows = []  # one per partition
    for line in read_file(spark, path).splitlines():
        if line.strip():
            *box, name = line.split(",", 6)
            rows.append((*map(float, box), name))
    return kind, spark.createDataFrame(rows, PARTITION)


def write_master(spark: SparkSession, index, directory: str) -> str:
    """The catalogue of an index as a legacy file; returns its path."""
    from tesselith.sources.files import write_text

    rows = index.show().collect()  # one row per partition
    text = "".join(",".join(repr(r[c]) for c in ("t1", "x1", "y1", "t2", "x2", "y2")) + f",{r['path']}\n" for r in rows)
    path = f"{directory}/_master.{index.kind}"
    write_text(spark, path, text)
    return path


def map_of_text(text: Column) -> Column:
    """map<string,string> of [k#v,k#v]; null for null, empty for []."""
    inner = F.regexp_replace(text, r"\A\[|\]\z", "")
    return F.when(inner == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(inner, F.lit(","), F.lit("#")))


def text_of_map(m: Column) -> Column:
    """[k#v,k#v] of a map, keys in order."""
    pairs = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("#"), F.coalesce(e["value"], F.lit(""))))
    return F.concat(F.lit("["), F.array_join(pairs, ","), F.lit("]"))
