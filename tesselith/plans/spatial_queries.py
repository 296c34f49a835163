"""Queries of the spatial operators over the test tables, with the SQL they are compared with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.functions import geometry as G
from tesselith.model import Box
from tesselith.operators import generate, join, range_query, raster, sample, stats
from tesselith.operators import grid as grids
from tesselith.operators.grid import Grid
from tesselith.session import cut, shared_dir
from tesselith.sources import index, text
from tesselith.sources.tables import table

QUERY = Box(1704500000.0, 10.0, 20.0, 1705500000.0, 60.0, 80.0)
SECOND = Box(1704067200.0, 0.0, 0.0, 1704100000.0, 150.0, 500.0)
AREA = Box(1704067200.0, 0.0, 0.0, 1706745600.0, 150.0, 500.0)
SPACE = Box(1704067200.0, -32768.0, -24576.0, 1963267200.0, 32768.0, 24576.0)
CELLS = Grid(SPACE, 1, 64, 48)
GRID = Grid(AREA, 2, 3, 3)
POINT = (1705000000.0, 50.0, 50.0)
#: A part of the space of the domain's tables in which their busy cells lie.
PART = Box(1704100000.0, -12000.0, -12000.0, 1706000000.0, 12000.0, 12000.0)
K = 10

_QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, base: str, inside: Box | None = None) -> DataFrame:
    return G.as_points(table(spark, base, "events"), "ts", "user_id", "value", {"id": "event_id", "event_type": "event_type", "value": "value"}, inside)


def prisms(spark: SparkSession, base: str) -> DataFrame:
    """Boxes delivered again are rows of their own here, as everywhere but in the p queries."""
    return table(spark, base, "prisms")


D = "(select epoch(ts) t, cast(user_id as double) x, value y, event_id id, event_type, value from events)"
_OPEN = lambda b, p="": " and ".join(f"{p}{a} > {l!r} and {p}{a} < {h!r}" for a, l, h in zip("txy", b.low, b.high))
_SOUND = lambda p, names: " and ".join(f"not isnan({p}{n})" for n in names)
_B = [f"{a}{i}" for i in "12" for a in "txy"]
_LAP = lambda a, b: " and ".join(f"{a}{d}1 < {b}{d}2 and {b}{d}1 < {a}{d}2" for d in "txy")
_LIT = lambda b: f"(select {', '.join(f'{v!r}::double {n}' for n, v in zip(_B, b.low + b.high))})"


# --- range queries ---


@query(f"select id, t, x, y from {D} where {_OPEN(QUERY)}")
def range_get(spark, base):
    return range_query.range_query(events(spark, base, QUERY), QUERY).select("id", "t", "x", "y")


@query(f"select id, t, x, y from {D} where {' and '.join(f'{a} >= {l!r} and {a} < {h!r}' for a, l, h in zip('txy', QUERY.low, QUERY.high))}")
def range_get_half_open(spark, base):
    return range_query.range_query(events(spark, base, QUERY), QUERY, boundary="half_open").select("id", "t", "x", "y")


@query(f"select id, t, x, y from {D} where {' and '.join(f'{a} between {l!r} and {h!r}' for a, l, h in zip('txy', QUERY.low, QUERY.high))}")
def range_get_closed(spark, base):
    return range_query.range_query(events(spark, base, QUERY), QUERY, boundary="closed").select("id", "t", "x", "y")


@query(f"select distinct event_type from {D} where {_OPEN(QUERY)}")
def range_distinct(spark, base):
    return range_query.range_query(events(spark, base, QUERY), QUERY, "distinct", "event_type")


@query(f"select event_type, count(*) cnt from {D} where {_OPEN(QUERY)} group by 1")
def range_distribution(spark, base):
    return range_query.range_query(events(spark, base, QUERY), QUERY, "distribution", "event_type")


@query(f"select round(avg(value), 6) average from {D} where {_OPEN(QUERY)}")
def range_average(spark, base):
    return range_query.range_query(events(spark, base, QUERY), QUERY, "average", "value").select(F.round("average", 6).alias("average"))


@query(f"select count(*) cnt from {D} where {_OPEN(QUERY)}")
def range_count(spark, base):
    return range_query.range_query(events(spark, base, QUERY), QUERY, "count")


@query(" union all ".join(f"select {i} range_id, count(*) cnt from {D} where {_OPEN(b)}" for i, b in enumerate((QUERY, SECOND))))
def range_count_multi(spark, base):
    return range_query.range_query_many(events(spark, base, QUERY.union(SECOND)), [QUERY, SECOND], "count")


@query(" union all ".join(f"select {i} range_id, event_type, count(*) cnt from {D} where {_OPEN(b)} group by 1, 2" for i, b in enumerate((QUERY, SECOND))))
def range_distribution_multi(spark, base):
    return range_query.range_query_many(events(spark, base, QUERY.union(SECOND)), [QUERY, SECOND], "distribution", "event_type")


@query(f"select data_value, count(*) cnt from datapoints where {_OPEN(PART)} group by 1")
def range_distribution_datapoints(spark, base):
    return range_query.range_query(table(spark, base, "datapoints"), PART, "distribution", "data_value")


@query(f"select distinct cell_id from datapoints where {_OPEN(PART)}")
def range_distinct_datapoints(spark, base):
    return range_query.range_query(table(spark, base, "datapoints"), PART, "distinct", "cell_id")


@query(f"select box_id, feed, t1, x1, y1 from prisms p, {_LIT(PART)} q where {_LAP('p.', 'q.')} and {_SOUND('p.', _B)}".replace("box_id, feed, t1, x1, y1", "p.box_id, p.feed, p.t1, p.x1, p.y1"))
def range_boxes(spark, base):
    return range_query.range_query(prisms(spark, base), PART).select("box_id", "feed", "t1", "x1", "y1")


@query(f"select id, t, x, y from {D} where {_OPEN(QUERY)}")
def range_sql(spark, base):
    G.register(spark)
    events(spark, base, QUERY).createOrReplaceTempView("tl_points")
    test = " and ".join(f"in_open({a}, {l!r}D, {h!r}D)" for a, l, h in zip("txy", QUERY.low, QUERY.high))
    return spark.sql(f"select id, t, x, y from tl_points where {test}")


# --- bounding boxes and counts ---


@query(f"select min(t) t1, min(x) x1, min(y) y1, max(t) t2, max(x) x2, max(y) y2 from {D}")
def mbr(spark, base):
    return stats.mbr(events(spark, base))


@query(f"select event_type, min(t) t1, min(x) x1, min(y) y1, max(t) t2, max(x) x2, max(y) y2 from {D} group by 1")
def mbr_by_type(spark, base):
    return stats.mbr(events(spark, base), "event_type")


@query("select " + ", ".join(f"min({c}) filter (not isnan({c})) {c}" for c in _B[:3]) + ", " + ", ".join(f"max({c}) filter (not isnan({c})) {c}" for c in _B[3:]) + " from prisms")
def mbr_boxes(spark, base):
    return stats.mbr(prisms(spark, base))


@query("select count(*) cnt from lineitem")
def record_count(spark, base):
    return stats.record_count(table(spark, base, "lineitem"))


@query(f"select count(*) cnt from {D} where {_OPEN(QUERY)}")
def record_count_in_box(spark, base):
    return stats.record_count(events(spark, base, QUERY), QUERY)


@query()
def approx_count(spark, base):
    found = stats.approx_count_range(table(spark, base, "lineitem"))
    return spark.createDataFrame([found], "cnt bigint, low bigint, high bigint")


@query("select count(*)::bigint cnt, true as within_interval, true as within_error from lineitem")
def approx_count_ok(spark, base):
    """The estimate's own claims: the true count lies in the interval, which is narrower than 1 % of it."""
    value, low, high = stats.approx_count_range(table(spark, base, "lineitem").repartition(200), seconds=0)
    cnt = table(spark, base, "lineitem").count()
    return spark.createDataFrame([(cnt, low <= cnt <= high, abs(value - cnt) <= 0.01 * cnt)], "cnt bigint, within_interval boolean, within_error boolean")


@query("""select 'gzip' kind, count(*)::bigint n_lines, true as within_error from lineitem
union all select 'unlike', (select count(*) from lineitem) + (select count(*) from orders), true""")
def approx_lines_ok(spark, base):
    """Text files of very different lines, and compressed ones: the true number of lines, and whether the estimate is within 1 %."""
    short = table(spark, base, "orders").select(F.col("o_orderkey").cast("string").alias("value"))
    lines = table(spark, base, "lineitem").select(F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_shipdate").cast("string"), F.repeat(F.col("l_returnflag"), 90)).alias("value"))
    out = []
    for kind, parts, codec in (("unlike", [lines.coalesce(1), short.coalesce(1)], "none"), ("gzip", [lines.repartition(12)], "gzip")):
        path = f"{shared_dir(spark)}/lines-{kind}-{uuid.uuid4().hex}"
        for part in parts:
            part.write.mode("append").text(path, compression=codec)
        exact = stats.line_count(spark, path).first()[0]
        out.append((kind, exact, abs(stats.approx_line_count(spark, path)[0] - exact) <= 0.01 * exact))
    return spark.createDataFrame(out, "kind string, n_lines bigint, within_error boolean")


# --- geometry of boxes ---

_ZP = f"(select z.zone_id a_id, {', '.join(f'z.{n} a_{n}' for n in _B)}, {', '.join(f'q.{n} b_{n}' for n in _B)} from zones z, {_LIT(SPACE)} q where {_SOUND('z.', _B)} and {' and '.join(f'z.{n} is not null' for n in _B)})"
#: A box in the middle of the space, against which zones are measured.
MIDDLE = Box(1704900000.0, -9000.0, -7000.0, 1705600000.0, 8000.0, 6000.0)
_Z = " and ".join(f"{n} is not null and not isnan({n})" for n in _B)
_G = lambda d: f"greatest(q.{d}1 - z.{d}2, z.{d}1 - q.{d}2, 0.0)"
_U = lambda d: f"(greatest(z.{d}2, q.{d}2) - least(z.{d}1, q.{d}1))"


def _zones(spark, base):
    return table(spark, base, "zones").where(" and ".join(f"{n} is not null and not isnan({n})" for n in _B))


@query(f"select zone_id, {', '.join(f'least(z.{n}, q.{n}) {n}' for n in _B[:3])}, {', '.join(f'greatest(z.{n}, q.{n}) {n}' for n in _B[3:])} from (select * from zones where {_Z}) z, {_LIT(MIDDLE)} q")
def box_union(spark, base):
    return _zones(spark, base).select("zone_id", G.union_box("", MIDDLE).alias("u")).select("zone_id", "u.*")


@query(f"select zone_id, {', '.join(f'greatest(z.{n}, q.{n}) {n}' for n in _B[:3])}, {', '.join(f'least(z.{n}, q.{n}) {n}' for n in _B[3:])} from (select * from zones where {_Z}) z, {_LIT(MIDDLE)} q where {_LAP('z.', 'q.')}")
def box_intersection(spark, base):
    return _zones(spark, base).select("zone_id", G.intersection("", MIDDLE).alias("u")).where("u is not null").select("zone_id", "u.*")


@query(f"""select zone_id, round(sqrt({' + '.join(f'{_G(d)} * {_G(d)}' for d in 'txy')}), 6) min_dist, round(sqrt({' + '.join(f'{_U(d)} * {_U(d)}' for d in 'txy')}), 6) max_dist,
{' and '.join(f'q.{d}1 <= z.{d}1 and z.{d}2 <= q.{d}2' for d in 'txy')} held from (select * from zones where {_Z}) z, {_LIT(MIDDLE)} q""")
def box_min_max_dist(spark, base):
    return _zones(spark, base).select("zone_id", F.round(G.min_dist_bb("", MIDDLE), 6).alias("min_dist"), F.round(G.max_dist_bb("", MIDDLE), 6).alias("max_dist"), G.contains(MIDDLE, "").alias("held"))


_MP = lambda d: f"greatest({d} - q.{d}1, q.{d}2 - {d})"
_NP = lambda d: f"greatest(q.{d}1 - {d}, {d} - q.{d}2, 0.0)"
_GAP = lambda d: f"least(abs({d} - q.{d}1), abs(q.{d}2 - {d}))"


@query(f"""select id, round(sqrt({' + '.join(f'{_MP(d)} * {_MP(d)}' for d in 'txy')}), 6) max_dist, round(sqrt({' + '.join(f'{_NP(d)} * {_NP(d)}' for d in 'txy')}), 6) min_dist,
round(case when {' and '.join(f'{d} >= q.{d}1 and {d} < q.{d}2' for d in 'txy')} then 0.0 when {' and '.join(f'({d} < q.{d}1 or {d} > q.{d}2)' for d in 'txy')} then sqrt({' + '.join(f'{_GAP(d)} * {_GAP(d)}' for d in 'txy')}) else least({', '.join(_GAP(d) for d in 'txy')}) end, 6) old_min_dist
from {D} d, {_LIT(QUERY)} q""")
def point_box_dist(spark, base):
    return events(spark, base).select("id", F.round(G.max_dist_pb("", QUERY), 6).alias("max_dist"), F.round(G.min_dist_pb("", QUERY), 6).alias("min_dist"), F.round(G.min_dist_pb("", QUERY, exact=False), 6).alias("old_min_dist"))


@query(f"select box_id, (t1 + t2) / 2 t, (x1 + x2) / 2 x, (y1 + y2) / 2 y, t2 - t1 as depth, x2 - x1 as width, y2 - y1 as height from prisms where {_Z}")
def box_center_extents(spark, base):
    return prisms(spark, base).where(" and ".join(f"{n} is not null and not isnan({n})" for n in _B)).select("box_id", *G.center(), *G.extents())


@query(f"select id, t t1, x x1, y y1, t t2, x x2, y y2 from {D}")
def point_mbr(spark, base):
    return events(spark, base).select("id", *G.mbr_of_point())


# --- grids and indexes ---

_IDX = lambda g, i, v: f"cast(greatest(0, least({g.counts[i] - 1}, floor(({v} - {g.box.low[i]!r}) / {g.widths[i]!r}))) as bigint)" if g.counts[i] > 1 else "0"
_CELL = lambda g, t, x, y: f"(({_IDX(g, 2, y)} * {g.columns} + {_IDX(g, 1, x)}) * {g.layers} + {_IDX(g, 0, t)} + 1)"
_P3 = "t is not null and x is not null and y is not null and not isnan(t) and not isnan(x) and not isnan(y)"


@query(f"select cast({_CELL(GRID, 't', 'x', 'y')} as bigint) cell_id, count(*) cnt from {D} group by 1")
def grid_histogram(spark, base):
    return grids.grid_histogram(events(spark, base), GRID)


@query(f"select id, cast({_CELL(CELLS, 't', 'x', 'y')} as bigint) cell from datapoints where {_P3}")
def grid_assign(spark, base):
    rows = table(spark, base, "datapoints").drop("cell_id")
    return grids.assign_cells(rows, CELLS).where("cell_id is not null").select("id", F.col("cell_id").alias("cell"))


@query("select cell_id, t1, x1, y1, t2, x2, y2 from cells")
def grid_cells(spark, base):
    return CELLS.cells(spark)


@query(f"select cast({_CELL(GRID, 't', 'x', 'y')} as bigint) cell_id, count(*) n, min(t) t1, min(x) x1, min(y) y1, max(t) t2, max(x) x2, max(y) y2 from {D} group by 1")
def grid_catalog(spark, base):
    found = grids.assign_cells(events(spark, base), GRID)
    return found.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), *[F.min(a).alias(f"{a}1") for a in "txy"], *[F.max(a).alias(f"{a}2") for a in "txy"])


def _index(spark, df, base, name, **kw):
    # A folder of its own for every call, so that runs don't meet.
    return index.build_index(df, f"{shared_dir(spark)}/index-{name}-{uuid.uuid4().hex}", **kw)


_RANGE = f"select id, t, x, y from {D} where {_OPEN(QUERY)}"


@query(_RANGE)
def range_indexed_grid(spark, base):
    return _index(spark, events(spark, base), base, "grid", kind="grid", grid=GRID).range_query(QUERY).select("id", "t", "x", "y")


@query(_RANGE)
def range_indexed_rtree(spark, base):
    return _index(spark, events(spark, base), base, "rtree", kind="rtree", block=128 << 10).range_query(QUERY).select("id", "t", "x", "y")


@query(f"select kind, (select count(*) from datapoints where {_P3})::bigint n, true as even, true as enough from (values ('grid'), ('rtree')) k(kind)")
def index_cells_even(spark, base):
    """Of indexes with as many cells as blocks: rows, whether the largest cell of a tree is within twice the mean (a grid
    promises no such thing), and whether there are as many cells as blocks of the data."""
    rows = table(spark, base, "datapoints").select("t", "x", "y", "id", "data_value")
    out = []
    for kind in ("grid", "rtree"):
        made = _index(spark, rows, base, f"even-{kind}", kind=kind, block=256 << 10)
        n = [r["n"] for r in made.catalog.select("n").collect()]  # a row a cell
        blocks = sum(n) * 40 // (256 << 10)
        out.append((kind, sum(n), kind == "grid" or max(n) <= 2 * sum(n) / len(n), kind == "grid" or len(n) >= blocks))
    return spark.createDataFrame(out, "kind string, n bigint, even boolean, enough boolean")


_BOXES = f"select p.box_id, p.t1, p.x1, p.y1, p.t2, p.x2, p.y2 from prisms p, {_LIT(PART)} q where {_LAP('p.', 'q.')} and {_SOUND('p.', _B)} and p.t1 <= p.t2 and p.x1 <= p.x2 and p.y1 <= p.y2"
#: Two layers of time and few, large cells, so that boxes cross faces.
COARSE = Grid(Box(1704067200.0, -32768.0, -24576.0, 1706745600.0, 32768.0, 24576.0), 6, 8, 6)


@query(_BOXES)
def range_indexed_boxes_grid(spark, base):
    return _index(spark, prisms(spark, base), base, "bgrid", kind="grid", grid=COARSE).range_query(PART).select("box_id", *_B)


@query(_BOXES)
def range_indexed_boxes_rplus(spark, base):
    return _index(spark, prisms(spark, base), base, "brp", kind="r+tree", counts=(3, 3, 2)).range_query(PART).select("box_id", *_B)


@query(_BOXES)
def range_indexed_boxes_rtree(spark, base):
    return _index(spark, prisms(spark, base), base, "brt", kind="rtree", counts=(3, 3, 2)).range_query(PART).select("box_id", *_B)


@query(f"select min(t) t1, min(x) x1, min(y) y1, max(t) t2, max(x) x2, max(y) y2, count(*) n from {D}")
def index_mbr_count(spark, base):
    made = _index(spark, events(spark, base), base, "mbr", kind="grid", grid=GRID)
    b = made.mbr()
    return spark.createDataFrame([(*b.low, *b.high, made.count())], ", ".join(f"{n} double" for n in _B) + ", n bigint")


@query(f"select 64::bigint n_cells, (select count(*) from datapoints where {_P3})::bigint n_rows, 0::bigint n_uneven")
def str_cells(spark, base):
    """Of 64 cells of equal numbers: how many there are, the rows that lie in them, each in one, and cells beyond twice the mean."""
    points = table(spark, base, "datapoints").select("id", "t", "x", "y")
    cells = grids.str_cells(points, (4, 4, 4))
    held = join.point_in_box_join(points, _bounded(cells)).groupBy("b_cell_id").agg(F.count(F.lit(1)).alias("n"))
    total = held.agg(F.sum("n")).first()[0]
    return held.agg(F.lit(cells.count()).alias("n_cells"), F.sum("n").alias("n_rows"), F.count_if(F.col("n") > total / 32).alias("n_uneven"))


def _bounded(cells: DataFrame) -> DataFrame:
    """Cells whose outer faces are beyond all data instead of infinite."""
    return cells.select("cell_id", *[F.greatest(F.col(c), F.lit(-1e12)).alias(c) for c in _B[:3]], *[F.least(F.col(c), F.lit(1e12)).alias(c) for c in _B[3:]])


@query(f"""with g as (select p.*, {', '.join(f"{_IDX(COARSE, i, f'{a}1')} f{a}, case when {COARSE.counts[i]} = 1 then 0 else cast(greatest({_IDX(COARSE, i, f'{a}1')}, least({COARSE.counts[i] - 1}, ceil(({a}2 - {COARSE.box.low[i]!r}) / {COARSE.widths[i]!r}) - 1)) as bigint) end l{a}" for i, a in enumerate('txy'))} from prisms p where {_Z}),
e as (select * from g, unnest(generate_series(fy, ly)) r(row_), unnest(generate_series(fx, lx)) c(col_), unnest(generate_series(ft, lt)) l(lay_))
select cast((row_ * {COARSE.columns} + col_) * {COARSE.layers} + lay_ + 1 as bigint) cell_id, count(*) cnt from e group by 1""")
def grid_replicate(spark, base):
    return grids.grid_histogram(prisms(spark, base), COARSE)


# --- joins and neighbours ---


@query(f"""select a.box_id a_id, b.zone_id b_id from prisms a join zones b on {_LAP('a.', 'b.')}
where {_SOUND('a.', _B)} and {_SOUND('b.', _B)} and {' and '.join(f'{p}{d}1 <= {p}{d}2' for p in ('a.', 'b.') for d in 'txy')}""")
def intersects_join(spark, base):
    got = join.intersects_join(prisms(spark, base), table(spark, base, "zones"))
    return got.select(F.col("a_box_id").alias("a_id"), F.col("b_zone_id").alias("b_id"))


@query(f"""with p as (select row_number() over () i, * from prisms where {_Z} and t1 <= t2 and x1 <= x2 and y1 <= y2),
g as (select *, unnest(generate_series(cast(floor(t1 / 5000) as bigint), cast(floor(t2 / 5000) as bigint))) s from p)
select a.box_id a_id, b.box_id b_id, count(distinct (a.i, b.i)) n from g a join g b on a.s = b.s and {_LAP('a.', 'b.')} where a.box_id < b.box_id group by 1, 2""")
def intersects_self_join(spark, base):
    p = prisms(spark, base).select("box_id", *_B)
    got = join.intersects_join(p, p).where("a_box_id < b_box_id")
    return got.groupBy(F.col("a_box_id").alias("a_id"), F.col("b_box_id").alias("b_id")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""select d.id, z.zone_id from datapoints d join zones z on {' and '.join(f'd.{a} >= z.{a}1 and d.{a} < z.{a}2' for a in 'txy')}
where {_SOUND('d.', 'txy')} and {_SOUND('z.', _B)} and z.t1 <= z.t2 and z.x1 <= z.x2 and z.y1 <= z.y2""")
def point_in_box_join(spark, base):
    got = join.point_in_box_join(table(spark, base, "datapoints"), table(spark, base, "zones"))
    return got.select(F.col("p_id").alias("id"), F.col("b_zone_id").alias("zone_id"))


@query(f"""with a as (select *, row_number() over () i from zones where {_Z} and t1 <= t2 and x1 <= x2 and y1 <= y2),
o as (select a.zone_id, c.cell_id, (least(a.x2, c.x2) - greatest(a.x1, c.x1)) * (least(a.y2, c.y2) - greatest(a.y1, c.y1)) common from a join cells c on {_LAP('a.', 'c.')})
select zone_id, cell_id, common from (select *, row_number() over (partition by zone_id order by common desc, cell_id) rn from o) where rn = 1""")
def best_cell(spark, base):
    return join.best_cell_join(table(spark, base, "zones"), table(spark, base, "cells"), "zone_id")


@query(f"""with c as (select cast({_CELL(GRID, 't', 'x', 'y')} as bigint) cell_id, min(t) t1, min(x) x1, min(y) y1, max(t) t2, max(x) x2, max(y) y2 from {D} group by 1),
d as (select event_type, min(t) t1, min(x) x1, min(y) y1, max(t) t2, max(x) x2, max(y) y2 from {D} group by 1)
select a.cell_id a_cell_id, cast(b.n as bigint) b_cell_id from c a join (select *, row_number() over (order by event_type) n from d) b on {_LAP('a.', 'b.')}""")
def cell_pair_join(spark, base):
    cells = grid_catalog(spark, base).drop("n")
    kinds = stats.mbr(events(spark, base), "event_type")
    numbers = {k: i for i, k in enumerate(sorted(r[0] for r in kinds.select("event_type").collect()), 1)}
    number = F.create_map(*[F.lit(v) for kv in numbers.items() for v in kv])
    return index.catalog_join(cells, kinds.withColumn("cell_id", number[F.col("event_type")].cast("bigint")))


_DIST = f"sqrt((t - {POINT[0]!r}) * (t - {POINT[0]!r}) + (x - {POINT[1]!r}) * (x - {POINT[1]!r}) + (y - {POINT[2]!r}) * (y - {POINT[2]!r}))"


@query(f"select id, round({_DIST}, 6) dist from {D} order by {_DIST}, id limit {K}")
def knn(spark, base):
    return join.knn(events(spark, base), POINT, K, "id").select("id", F.round("dist", 6).alias("dist"))


_SCALED = f"sqrt(((t - {POINT[0]!r}) * 0.0001) * ((t - {POINT[0]!r}) * 0.0001) + (x - {POINT[1]!r}) * (x - {POINT[1]!r}) + (y - {POINT[2]!r}) * (y - {POINT[2]!r}))"


@query(f"select id, round({_SCALED}, 6) dist from {D} order by {_SCALED}, id limit {K}")
def knn_scaled(spark, base):
    return join.knn(events(spark, base), POINT, K, "id", (0.0001, 1.0, 1.0)).select("id", F.round("dist", 6).alias("dist"))


@query(f"""with z as (select zone_id, t1 t, x1 x, y1 y from zones where t1 is not null and x1 is not null and y1 is not null and {_SOUND('', _B[:3])}),
p as (select distinct id, t, x, y from datapoints where {_P3}),
d as (select zone_id, id, sqrt((z.t - p.t) * (z.t - p.t) + (z.x - p.x) * (z.x - p.x) + (z.y - p.y) * (z.y - p.y)) dist from z, p)
select zone_id left_id, id right_id, round(dist, 6) dist, cast(r as integer) rank from (select *, row_number() over (partition by zone_id order by dist, id) r from d) where r <= 5""")
def knn_join(spark, base):
    left = table(spark, base, "zones").select(F.col("zone_id").alias("id"), *[F.col(f"{a}1").alias(a) for a in "txy"])
    got = join.knn_join(left, table(spark, base, "datapoints").select("id", "t", "x", "y"), 5)
    return got.withColumn("dist", F.round("dist", 6))


@query(f"""with p as (select distinct id, t, x, y from datapoints where {_P3} and id is not null),
n as (select l.id left_id, min({{'d': sqrt((l.t - r.t) * (l.t - r.t) + (l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y)), 'i': r.id}}, 5) m from p l, p r where l.id % 20 = 0 group by l.id, l.t, l.x, l.y),
u as (select left_id, unnest(m) s from n)
select left_id, s.i right_id, round(s.d, 6) dist, cast(row_number() over (partition by left_id order by s.d, s.i) as integer) as rank from u""")
def knn_join_datapoints(spark, base):
    """Every datapoint whose id is divisible by 20 against all datapoints, itself included."""
    points = table(spark, base, "datapoints").select("id", "t", "x", "y")
    got = join.knn_join(points.where("id % 20 = 0"), points, 5)
    return got.withColumn("dist", F.round("dist", 6))


# --- order, samples, generators, pixels, text ---


@query(f"select id, t, x, y from {D} order by id desc limit 25")
def tail_n(spark, base):
    return sample.tail(events(spark, base), 25, "id").select("id", "t", "x", "y")


@query(f"select id, t, x, y from {D} order by t, x, y limit 100")
def shape_order(spark, base):
    return events(spark, base).orderBy(*G.shape_order()).limit(100).select("id", "t", "x", "y")


@query(f"select id, t, x, y, row_number() over (order by t nulls first, x nulls first, y nulls first, id nulls first) as rank from {D}")
def shape_order_all(spark, base):
    return sample.ranked_order(events(spark, base), [*G.shape_order(), F.col("id")]).select("id", "t", "x", "y", "rank")


@query()
def sample_ratio(spark, base):
    return sample.sample_ratio(events(spark, base), 0.1, 7)


@query()
def sample_count(spark, base):
    return sample.sample_count(events(spark, base), 500, 7, ["id"])


@query()
def sample_bytes(spark, base):
    return sample.sample_bytes(events(spark, base).select("t", "x", "y"), 20_000, 7)


@query(f"select id, event_type from {D}")
def shuffle_rows(spark, base):
    return sample.shuffle_rows(events(spark, base).select("id", "event_type"), 7)


@query("select 500::bigint n, 500::bigint n_ids, 0::bigint n_foreign from (select count(*) c from events) where c >= 500")
def sample_count_ok(spark, base):
    """Rows of a sample of 500, different ones, and such as the table doesn't hold."""
    own = events(spark, base)
    drawn = cut(sample.sample_count(own, 500, 7, ["id"]))
    foreign = drawn.join(own, ["id", "t", "x", "y"], "left_anti").count()
    return drawn.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"), F.lit(foreign).cast("bigint").alias("n_foreign"))


@query("select true as within_share, 0::bigint n_repeated, true as within_bytes, true as nearly_full")
def sample_shares_ok(spark, base):
    """A share of a tenth within five deviations and without repeats; a sample by bytes within its size, and near it."""
    own = events(spark, base)
    n = own.count()
    part = cut(sample.sample_ratio(own, 0.1, 7))
    got, ids = part.agg(F.count(F.lit(1)), F.countDistinct("id")).first()
    line = F.octet_length(F.concat_ws(",", *[F.col(c).cast("string") for c in "txy"])) + 1
    used, most = sample.sample_bytes(own.select("t", "x", "y"), 20_000, 7).agg(F.sum(line), F.max(line)).first()
    return spark.createDataFrame([(abs(got - 0.1 * n) <= 5 * (0.09 * n) ** 0.5, got - ids, used <= 20_000, used > 20_000 - most)], "within_share boolean, n_repeated bigint, within_bytes boolean, nearly_full boolean")


@query("select kind, 10000::bigint n, 0::bigint n_outside, true as as_shaped from (values ('anti_correlated'), ('box'), ('circle'), ('correlated'), ('gaussian'), ('uniform')) k(kind)")
def generate_ok(spark, base):
    """Of 10,000 records of each distribution: how many there are, how many lie outside the box, and whether middle, spread
    and correlation of x and y (of boxes the extents) are those of the distribution."""
    half = [(h - l) / 2 for l, h in zip(AREA.low, AREA.high)]
    out = []
    for kind in ("uniform", "gaussian", "correlated", "anti_correlated", "circle"):
        rows = generate.generate(spark, 10_000, AREA, kind, seed=1)
        u, v = ((F.col(a) - F.lit((l + h) / 2)) / F.lit(w) for a, l, h, w in zip("xy", AREA.low[1:], AREA.high[1:], half[1:]))
        r = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~G.within(AREA, "closed")).alias("out"), F.avg(u).alias("mean"), F.stddev(u).alias("sd"), F.corr("x", "y").alias("corr"), F.avg(F.sqrt(u * u + v * v)).alias("r")).first()
        # Of a uniform value over two half extents the deviation is 1 / sqrt(3).
        shaped = abs(r["mean"]) < 0.05 and {
            "uniform": abs(r["sd"] - 3**-0.5) < 0.02 and abs(r["corr"]) < 0.05,
            "gaussian": abs(r["sd"] - generate.SIGMA) < 0.01 and abs(r["corr"]) < 0.05,
            "correlated": abs(r["sd"] - 3**-0.5) < 0.02 and r["corr"] > 0.9,
            "anti_correlated": abs(r["sd"] - 3**-0.5) < 0.02 and r["corr"] < -0.9,
            "circle": abs(r["r"] - generate.RADIUS) < 0.01 and abs(r["corr"]) < 0.05,
        }[kind]
        out.append((kind, r["n"], r["out"], shaped))
    boxes = generate.generate(spark, 10_000, AREA, shape="box", seed=1)
    ends = [F.col(f"{a}2") - F.col(f"{a}1") for a in "txy"]
    outside = F.lit(False)
    for a, l, h in zip("txy", AREA.low, AREA.high):
        outside |= (F.col(f"{a}1") < F.lit(l)) | (F.col(f"{a}2") > F.lit(h))
    r = boxes.agg(F.count(F.lit(1)).alias("n"), F.count_if(outside).alias("out"), F.min(F.least(*ends)).alias("low"), F.max(F.greatest(*ends)).alias("high")).first()
    out.append(("box", r["n"], r["out"], r["low"] >= 0 and r["high"] <= 101 + 1e-6))  # rounding of epoch seconds
    return spark.createDataFrame(out, "kind string, n bigint, n_outside bigint, as_shaped boolean")


@query()
def generate_uniform(spark, base):
    return generate.generate(spark, 10_000, AREA, "uniform", "datapoint", 1)


@query()
def generate_gaussian(spark, base):
    return generate.generate(spark, 10_000, AREA, "gaussian", seed=1)


@query()
def generate_correlated(spark, base):
    return generate.generate(spark, 10_000, AREA, "correlated", seed=1)


@query()
def generate_anti_correlated(spark, base):
    return generate.generate(spark, 10_000, AREA, "anti_correlated", seed=1)


@query()
def generate_circle(spark, base):
    return generate.generate(spark, 10_000, AREA, "circle", seed=1)


@query()
def generate_boxes(spark, base):
    return generate.generate(spark, 10_000, AREA, shape="box", seed=1)


@query(f"""with m as (select min(x) x1, max(x) x2, min(y) y1, max(y) y2 from {D}),
p as (select cast(floor((x - x1) * 100.0 / (x2 - x1)) as bigint) px, cast(floor((y - y1) * 100.0 / (y2 - y1)) as bigint) py from {D}, m)
select px, py, count(*) n from p where px < 100 and py < 100 group by 1, 2""")
def plot_pixels(spark, base):
    return raster.pixels(events(spark, base), 100, 100)


@query(f"""with s as (select * from prisms where {_SOUND('', _B)} and x1 is not null and x2 is not null and y1 is not null and y2 is not null and x1 <= x2 and y1 <= y2 and x2 >= -32768 and y2 >= -24576 and x1 <= 32768 and y1 <= 24576),
e as (select greatest(-1, least(200, floor((x1 + 32768.0) * 200.0 / 65536.0)))::bigint l, greatest(-1, least(200, floor((x2 + 32768.0) * 200.0 / 65536.0) + 1))::bigint r,
greatest(-1, least(150, floor((y1 + 24576.0) * 150.0 / 49152.0)))::bigint b, greatest(-1, least(150, floor((y2 + 24576.0) * 150.0 / 49152.0) + 1))::bigint t, row_number() over () i from s),
p as (select i, unnest(generate_series(l, r)) px, b py from e union select i, unnest(generate_series(l, r)), t from e union select i, l, unnest(generate_series(b, t)) from e union select i, r, unnest(generate_series(b, t)) from e)
select px, py, count(*) n from p where px >= 0 and px < 200 and py >= 0 and py < 150 group by 1, 2""".replace(f"{_SOUND('', _B)} and ", "not isnan(x1) and not isnan(y1) and not isnan(x2) and not isnan(y2) and "))
def plot_boxes(spark, base):
    return raster.pixels(prisms(spark, base), 200, 150, SPACE)


@query("select key, value from (select 'a' as key, cast(o_orderkey as varchar) as value from orders union all select 'b', o_orderstatus from orders)")
def map_text(spark, base):
    rows = table(spark, base, "orders").select(F.format_string("[a#%s,b#%s]", F.col("o_orderkey").cast("string"), F.col("o_orderstatus")).alias("m"))
    return rows.select(F.explode(text.map_of_text(F.col("m"))))


@query("select concat_ws(',', cast(id as varchar), cast(data_value as varchar)) as value from (select id, coalesce(cast(data_value as varchar), '') data_value from datapoints)")
def shape_text(spark, base):
    return table(spark, base, "datapoints").select(G.to_text(["id", "data_value"]).alias("value"))


QUERIES = _QUERIES
