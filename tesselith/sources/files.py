"""Small files and file lists of any file system that Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it wants it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def write_bytes(spark: SparkSession, path: str, data: bytes, overwrite: bool = True) -> None:
    fs, p = file_system(spark, path)
    if not overwrite and fs.exists(p):
        raise FileExistsError(path)
    out = fs.create(p, overwrite)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def read_file(spark: SparkSession, path: str) -> str:
    """Text of one small file; its name may start with an underscore, which Spark's own readers pass over."""
    fs, p = file_system(spark, path)
    data = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")
    finally:
        data.close()


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int, int, int]]:
    """(path, bytes, blocks, time of the last change) of the files below a path, without hidden ones (names that start with _ or .)."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    root = fs.getFileStatus(p).getPath().toString()
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        s = files.next()
        name = s.getPath().toString()
        inner = name[len(root) :].strip("/") or s.getPath().getName()
        if not any(part.startswith(("_", ".")) for part in inner.split("/")):
            found.append((inner, s.getLen(), -(-s.getLen() // max(1, s.getBlockSize())), s.getModificationTime()))
    return sorted(found)
