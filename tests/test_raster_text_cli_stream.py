import math
import os
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesselith import cli
from tesselith.model import BOX, DATAPOINT, POINT, Box
from tesselith.operators import raster as R
from tesselith.operators.grid import Grid
from tesselith.sources import batches as B
from tesselith.sources import text as T
from tesselith.streaming import spatial as ST

VIEW = Box(0, 0, 0, 1, 10, 10)


def read_png(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, out = 8, {}
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        out[kind] = body
        at += 12 + n
    w, h = struct.unpack(">II", out[b"IHDR"][:8])
    return np.frombuffer(zlib.decompress(out[b"IDAT"]), dtype="uint8").reshape(h, 1 + w * 4)[:, 1:].reshape(h, w, 4)


def test_pixels_of_points(spark):
    rows = [(0.0, 0.0, 0.0), (0.0, 0.4, 0.9), (0.0, 9.99, 9.99), (0.0, 10.0, 5.0), (0.0, -0.1, 5.0), (0.0, None, 1.0), (0.0, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, POINT)
    assert sorted(map(tuple, R.pixels(df, 10, 10, VIEW).collect())) == [(0, 0, 2), (9, 9, 1)]
    assert R.pixels(df.where("false"), 10, 10).count() == 0
    flat = spark.createDataFrame([(0.0, 3.0, 1.0), (1.0, 3.0, 2.0)], POINT)
    assert sorted(map(tuple, R.pixels(flat, 4, 4).collect())) == [(0, 0, 1)]


def test_pixels_of_boxes(spark):
    df = spark.createDataFrame([(0.0, 2.0, 3.0, 1.0, 4.0, 5.0), (0.0, -50.0, -50.0, 1.0, 50.0, 50.0), (0.0, 5.0, 5.0, 1.0, 1.0, 9.0)], BOX)
    got = {(r["px"], r["py"]) for r in R.pixels(df, 10, 10, VIEW).collect()}
    want = {(x, y) for x in range(2, 6) for y in (3, 6)} | {(x, y) for y in range(3, 7) for x in (2, 5)}
    assert got == want


def test_images(spark, tmp_path):
    assert R.fit_size(VIEW, 100, 50) == (50, 50) and R.fit_size(Box(0, 0, 0, 1, 20, 10), 100, 90) == (100, 50) and R.fit_size(Box(0, 0, 0, 0, 0, 0), 5, 6) == (5, 6)
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (0.0, 5.0, 5.0), (0.0, 5.0, 5.0), (0.0, 10.0, 10.0)], POINT)
    path = str(tmp_path / "a.png")
    assert R.plot_png(df, path, 20, 40, "red", shade=True) == (20, 20)
    with open(path, "rb") as f:
        image = read_png(f.read())
    assert image.shape == (20, 20, 4) and tuple(image[10, 10]) == (255, 0, 0, 255) and image[0, 0, 3] < 255 and image[5, 5, 3] == 0
    both = R.combine_pixels([R.pixels(df, 4, 4, VIEW), R.pixels(df, 4, 4, VIEW)])
    assert {(r["px"], r["py"]): r["n"] for r in both.collect()} == {(0, 0): 2, (2, 2): 4}
    a, b = R.draw(both, 4, 4, "blue"), np.zeros((4, 4, 4), dtype="uint8")
    b[2, 2] = (0, 255, 0, 255)
    assert tuple(R.overlay(a, b)[2, 2]) == (0, 255, 0, 255) and tuple(R.overlay(a, b)[0, 0]) == (0, 0, 255, 255)
    assert tuple(R.draw_borders(b, VIEW, [VIEW], "orange")[0, 3]) == (255, 200, 0, 255)
    with pytest.raises(ValueError):
        R.draw(both, 100_000, 100_000)
    with pytest.raises(ValueError):
        R.plot_png(df.where("false"), path)


def test_lines_and_rings(spark):
    view = Box(0, 0, 0, 1, 8, 8)
    lines = [(0.5, 0.5, 3.5, 0.5), (0.5, 0.5, 0.5, 3.5), (1e9, 1e9, -1e9, -1e9), (20.0, 1.0, 20.0, 5.0), (6.5, 6.5, 6.5, 6.5), (None, 1.0, 2.0, 2.0), (math.nan, 1.0, 2.0, 2.0), (math.inf, 1.0, 2.0, 2.0), (-5.0, 7.5, 50.0, 7.5)]
    got = {(r["px"], r["py"]): r["n"] for r in R.line_pixels(spark.createDataFrame(lines, "ax double, ay double, bx double, by double"), 8, 8, view).collect()}
    want = {}
    for cells in ([(x, 0) for x in range(4)], [(0, y) for y in range(4)], [(i, i) for i in range(8)], [(6, 6)], [(x, 7) for x in range(8)]):
        for c in cells:
            want[c] = want.get(c, 0) + 1
    assert got == want
    rings = spark.createDataFrame([([{"x": 1.5, "y": 1.5}, {"x": 5.5, "y": 1.5}, {"x": 5.5, "y": 4.5}, {"x": 1.5, "y": 4.5}],), ([],), (None,), ([{"x": 1.0, "y": None}, {"x": 2.0, "y": 2.0}],)], "ring array<struct<x:double,y:double>>")
    got = {(r["px"], r["py"]) for r in R.ring_pixels(rings, 8, 8, view).collect()}
    assert got == {(x, y) for x in range(1, 6) for y in (1, 4)} | {(x, y) for x in (1, 5) for y in range(1, 5)}


def test_tables_of_different_extents_on_one_view(spark):
    a = spark.createDataFrame([(0.0, 0.0, 0.0), (0.0, 1.0, 1.0)], "t double, x double, y double")
    b = spark.createDataFrame([(0.0, 3.0, 3.0), (0.0, 4.0, 4.0)], "t double, x double, y double")
    image = R.combine_tables([a, b], 4, 4, ["red", "blue"])
    assert tuple(image[0, 0]) == tuple(image[1, 1]) == (255, 0, 0, 255) and tuple(image[3, 3]) == (0, 0, 255, 255) and image[2, 2, 3] == 0
    with pytest.raises(ValueError):
        R.combine_tables([a.where("false")])


def test_text_files(spark, tmp_path):
    df = spark.createDataFrame([(1.5, -2.0, 3.0, 42, 7), (1e9, 0.1, 0.2, None, None)], DATAPOINT)
    for codec in ("none", "gzip"):
        path = str(tmp_path / codec)
        T.write_shapes(df, path, compression=codec)
        assert sorted(T.read_shapes(spark, path).collect(), key=str) == sorted(T.read_shapes(spark, path, "datapoint").collect(), key=str) == sorted(df.collect(), key=str)
        assert T.read_lines(spark, path).count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        T.write_shapes(df, path)
    T.write_pairs(spark.createDataFrame([("a", 1), (None, 2), ("c", None), (None, None)], "k string, v int"), str(tmp_path / "kv"), "k", "v")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "kv")).collect()) == ["2", "a\t1", "c"]
    m = spark.createDataFrame([("[a#1,b#2]",), ("[]",), (None,)], "s string").select(T.map_of_text(F.col("s")).alias("m"))
    assert [r["m"] for r in m.collect()] == [{"a": "1", "b": "2"}, {}, None]
    assert [r[0] for r in m.select(T.text_of_map(F.col("m"))).collect()] == ["[a#1,b#2]", "[]", None]


def test_batches(spark):
    df = spark.range(1000, numPartitions=3).selectExpr("id", "repeat('x', 100) v")
    sizes = lambda rows, nbytes: [r["n"] for r in B.map_batches(df, lambda b: pd.DataFrame({"n": [len(b)]}), "n bigint", rows, nbytes).collect()]
    assert sum(sizes(100, 1 << 30)) == 1000 and max(sizes(100, 1 << 30)) == 100 and len(sizes(10_000, 1 << 30)) == 3
    assert max(sizes(10, 1)) == 10 and B.map_batches(df.where("false"), lambda b: b[["id"]], "id bigint").count() == 0
    with pytest.raises(ValueError):
        B.map_batches(df, lambda b: b, "id bigint", 0)


def test_command_line(spark, tmp_path, capsys):
    p = lambda name: str(tmp_path / name)

    def run(*args):
        capsys.readouterr()
        assert cli.main(list(args), spark) == 0
        return capsys.readouterr().out.split("\n")[:-1]

    run("generate", p("d"), "mbr:0,0,0,10,10,10", "count:500", "shape:datapoint", "seed:3", "type:gaus")
    assert run("count", p("d"), "-local") == ["500"] and 450 < int(run("count", p("d"), "-local", "-random", "seed:1")[0]) < 550
    box = "prism:3,3,3,7,7,7"
    n = int(run("count", p("d"), box, "shape:datapoint")[0])
    assert 0 < n < 500
    run("index", p("d"), p("g"), "sindex:grid", "grid:2,2,2", "shape:datapoint")
    run("index", p("d"), p("r"), "sindex:r+tree", "cells-of:" + p("g"), "shape:datapoint") if False else None
    run("index", p("d"), p("r"), "sindex:rtree", "columnar:columnar", "shape:datapoint", "blocksize:1.k")
    for at in ("d", "g", "r"):
        out = run("rangequery", p(at), box, "query:distribution", "field:data_value", "shape:datapoint")
        assert out[-1] == f"Result size: {n}" and sum(int(x.split(",")[1]) for x in out[:-1]) == n
    assert run("rangequery", p("d"), p("out"), box, "query:distinct", "field:id", "shape:datapoint")[-1] == f"Result size: {n}"
    assert os.path.exists(p("out/_SUCCESS"))
    assert run("mbr", p("d"), "shape:datapoint") == run("mbr", p("g")) == run("mbr", p("r"))
    assert run("readfile", p("g"))[0] == "grid" and len(run("readfile", p("g"), "offset:1")) == 2 and run("readfile", p("d"))[0].startswith("heap")
    sizes = {f.name: f.stat().st_size for f in (tmp_path / "d").iterdir() if f.name.startswith("part-")}
    assert dict((r.split(",")[0], int(r.split(",")[1])) for r in run("readfile", p("d"))[1:]) == sizes
    assert sum(int(r.split(",")[-1]) for r in run("readfile", p("g"))[1:]) == sum(f.stat().st_size for f in (tmp_path / "g").rglob("part-*") if "index_cell" in str(f))
    assert not os.path.exists(p("d/_mbr.json"))
    was = run("mbr", p("d"), "shape:datapoint", "-remember")
    assert os.path.exists(p("d/_mbr.json")) and run("mbr", p("d"), "shape:point") == was
    with open(p("d/part-more.csv"), "w") as f:
        f.write("50.0,5.0,5.0,1,1\n")
    assert run("mbr", p("d"), "shape:datapoint") != was
    os.remove(p("d/part-more.csv"))
    more = run("rangequery", p("d"), p("two"), box, "prism:0,0,0,5,5,5", "query:get", "shape:datapoint", "concurrency:2")
    assert more[0] == f"Result size: {n}" and os.path.exists(p("two/range_1/_SUCCESS"))
    assert len(run("rangequery", p("d"), box, "shape:datapoint")) == n + 1 and len(run("rangequery", p("d"), box, "shape:datapoint", "show:3")) == 4
    assert len(run("sample", p("d"), "count:20", "seed:1")) == 20 and 20 < len(run("sample", p("d"), "ratio:0.1", "seed:1")) < 90
    assert len(run("sample", p("d"), "size:1.k", "seed:1", "outshape:point", "shape:datapoint")[0].split(",")) == 3
    run("plot", p("g"), p("a.png"), "width:50", "height:50", "color:green", "-borders")
    with open(p("a.png"), "rb") as f:
        assert read_png(f.read()).shape[2] == 4
    with pytest.raises(FileExistsError):
        cli.main(["plot", p("g"), p("a.png")], spark)
    run("plot", p("g"), p("a.png"), "-overwrite")
    run("plot", p("g"), p("d"), p("b.png"), "shape:datapoint", "width:20", "height:20")
    assert os.path.exists(p("b.png"))
    assert len(run("knn", p("d"), "point:5,5,5", "k:3", "shape:datapoint")) == 3 and len(run("tail", p("d"), "count:4")) == 4
    run("shuffle", p("d"), p("s"), "seed:1")
    assert run("count", p("s"), "-local") == ["500"]
    run("generate", p("b"), "mbr:0,0,0,100,100,100", "count:50", "shape:rect", "seed:3")
    assert len(run("join", p("b"), p("b"), "shape:rect")) >= 50
    run("generate", p("gi"), "mbr:0,0,0,10,10,10", "size:2.k", "sindex:grid", "seed:1")
    assert int(run("count", p("gi"))[0]) > 10
    assert cli.main([], spark) == 2 and cli.main(["nothing"], spark) == 2
    with pytest.raises(ValueError):
        cli.main(["generate", p("x")], spark)


def test_arguments():
    a = cli.Arguments.parse(["/in", "hdfs://h/x", "prism:0,0,0,1,1,1", "rect:1,1,1,2,2,2", "k:5", "-overwrite"])
    assert a.paths == ["/in", "hdfs://h/x"] and len(a.boxes) == 2 and a.get("k", 1, int) == 5 and a.mode == "overwrite"
    assert cli.parse_size("10") == 10 and cli.parse_size("2.k") == 2048 and cli.parse_size("1.t") == 2**40 and cli.parse_size("1.5m") == 3 * 2**19
    with pytest.raises(ValueError):
        cli.parse_size("big")


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, 10.0, 1.0, 1.0), (2, 20.0, 1.0, 1.0), (3, 3700.0, 9.0, 9.0), (4, 90_000.0, 9.0, 9.0), (5, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id bigint, t double, x double, y double")
    df.coalesce(1).write.parquet(src)
    grid = Grid(Box(0, 0, 0, 1e6, 10, 10), 1, 2, 2)

    def play(stream, name, mode="append"):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.table(name).collect()

    read = lambda: ST.shape_stream(spark, src, df.schema, "parquet")
    assert {r["id"] for r in play(ST.range_stream(read(), Box(0, 0, 0, 5000, 5, 5)), "ranged")} == {1, 2}
    assert {r["id"]: r["cell_id"] for r in play(ST.cell_stream(read(), grid), "celled")} == {1: 1, 2: 1, 3: 4, 4: 4, 5: None}
    counts = play(ST.cell_counts(read(), grid), "counted")
    assert {(r["window_start"].timestamp(), r["cell_id"]): r["cnt"] for r in counts} == {(0.0, 1): 2, (3600.0, 4): 1}
    timed = read().where("t is not null").withColumn("at", F.timestamp_seconds(F.col("t")))
    twice = timed.withColumn("id", F.explode(F.array("id", "id")))
    assert sorted(r["id"] for r in play(ST.first_arrivals(twice, "id", "at"), "once")) == [1, 2, 3, 4]
