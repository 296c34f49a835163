"""Queries over the domain's tables for bad lines, neighbourhood and hot keys, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.operators import hot_keys, parse_rules, proximity
from tesselith.sources.tables import table

NEAR_DISTANCE, JOIN_DISTANCE = 25.0, 400.0
HEAVY_SHARE = (1, 50)


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return parse_rules.rejected(table(spark, base, "raw_prisms"), "raw_line", ["line_id"]).select("line_id")


def p1_reasons(spark: SparkSession, base: str) -> DataFrame:
    bad = parse_rules.rejected(table(spark, base, "raw_prisms"), "raw_line", ["line_id"])
    return bad.select("line_id", F.array_join("reasons", "; ").alias("reasons"))


def p1_loaded(spark: SparkSession, base: str) -> DataFrame:
    return parse_rules.loaded(table(spark, base, "raw_prisms"), "raw_line", ["line_id"])


def p1_reason_counts(spark: SparkSession, base: str) -> DataFrame:
    return parse_rules.reason_counts(table(spark, base, "raw_prisms"), "raw_line", ["line_id", "file_name"], ["file_name"])


def _corners(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "prisms").select(F.col("box_id").alias("point_id"), *[F.col(f"{c}1").alias(c) for c in "txy"])


def _near(spark: SparkSession, base: str) -> DataFrame:
    return proximity.near_pairs(_corners(spark, base), NEAR_DISTANCE)


def _inside(spark: SparkSession, base: str) -> DataFrame:
    regions = proximity.rings_of_boxes(table(spark, base, "zones"), "zone_id")
    return proximity.regions_of(_corners(spark, base), regions)


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    near = _near(spark, base).select(F.lit("near").alias("rel"), "a_id", "b_id")
    inside = _inside(spark, base).select(F.lit("inside").alias("rel"), F.col("region_id").alias("a_id"), F.col("point_id").alias("b_id"))
    return near.unionByName(inside)


def p2_zone_counts(spark: SparkSession, base: str) -> DataFrame:
    return _inside(spark, base).groupBy(F.col("region_id").alias("zone_id")).agg(F.count(F.lit(1)).alias("n_boxes"))


def distance_join(spark: SparkSession, base: str) -> DataFrame:
    """Data points and low corners of prisms near each other, over both whole tables."""
    records = table(spark, base, "datapoints").select(F.col("id").alias("point_id"), *"txy")
    found = proximity.distance_join(records, _corners(spark, base), JOIN_DISTANCE)
    return found.select(F.col("a_id").alias("id"), F.col("b_id").alias("box_id"))


#: Four polygons around one point, with coordinates that no binary fraction equals.
_HUB, _RIM = (0.1, 0.7), ((-3.3, -2.9), (4.7, -3.1), (5.3, 6.1), (-2.3, 4.9))
_FANS = [(i, [_HUB, _RIM[i], (1.7 * (_RIM[i][0] + _RIM[(i + 1) % 4][0]) / 2, 1.7 * (_RIM[i][1] + _RIM[(i + 1) % 4][1]) / 2), _RIM[(i + 1) % 4]], 0.0, 1.0) for i in range(4)]


def regions_shared_edges(spark: SparkSession, base: str) -> DataFrame:
    """Each record is put on an edge that two of four polygons share; in how many of them it lies (one, always)."""
    regions = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in ring], t1, t2) for i, ring, t1, t2 in _FANS], "region_id bigint, ring array<struct<x:double,y:double>>, t1 double, t2 double")
    share = F.pmod("rec_id", F.lit(9973)) / F.lit(9973.0)
    end = [F.element_at(F.array(*[F.lit(p[i]) for p in _RIM]), (F.pmod("rec_id", F.lit(4)) + 1).cast("int")) for i in (0, 1)]
    on = [F.lit(h) + share * (e - F.lit(h)) for h, e in zip(_HUB, end)]
    pts = table(spark, base, "points").select(F.col("rec_id").alias("point_id"), F.lit(0.5).alias("t"), on[0].alias("x"), on[1].alias("y"))
    found = proximity.regions_of(pts, regions)
    return found.groupBy(F.col("point_id").alias("rec_id")).agg(F.count(F.lit(1)).alias("n_regions"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return hot_keys.heavy_keys(table(spark, base, "datapoints"), "cell_id", HEAVY_SHARE).select("cell_id")


def p4_cells(spark: SparkSession, base: str) -> DataFrame:
    return hot_keys.key_stats(table(spark, base, "datapoints"), "cell_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p1_loaded, p1_reason_counts, p2_found, p2_zone_counts, distance_join, regions_shared_edges, p4_found, p4_cells)}

# --- SQL -----------------------------------------------------------------------------------------------------------

_NUM = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_NAMES = parse_rules.BOX_COLUMNS
_PARSE = rf"""
with l as (select line_id, file_name, raw_line, regexp_replace(raw_line, '\r\z', '') b from raw_prisms),
q as (select *, coalesce(regexp_full_match(b, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*'), false) ok from l),
s as (select *, case when ok then regexp_extract_all(',' || b, ',("(?:[^"]|"")*"|[^",]*)', 1) end f from q),
u as (select *, list_transform(f, lambda v: trim(case when starts_with(v, '"') then replace(v[2:length(v) - 1], '""', '"') else v end, ' ' || chr(9))) c from s),
n as (select line_id, file_name, raw_line, ok, len(f) k, {", ".join(f"case when len(c) = 6 and regexp_full_match(c[{i}], '{_NUM}') then coalesce(try_cast(ltrim(c[{i}], '+') as double), 'inf'::double) end v{i}" for i in range(1, 7))} from u),
e as (select *, list_filter([
  case when raw_line is null then 'line is null' end,
  case when raw_line is not null and not ok then 'broken quoting' end,
  case when ok and k <> 6 then 'not 6 fields' end,
  {", ".join(
    f"case when k = 6 and v{i} is null then '{c} is not a number' end, case when abs(v{i}) = 'inf'::double then '{c} is not finite' end"
    + (f", case when abs(v{i - 3}) < 'inf'::double and abs(v{i}) < 'inf'::double and v{i - 3} > v{i} then '{_NAMES[i - 4]} > {c}' end" if i > 3 else "")
    for i, c in enumerate(_NAMES, 1))}], lambda r: r is not null) reasons from n)
"""

# The reasons of one column are in alphabetical order: t1 > t2 before "t2 is ...", as only one of them can hold.
ORACLES = {
    "p1_found": _PARSE + "select distinct line_id from e where len(reasons) > 0",
    "p1_reasons": _PARSE + "select line_id, array_to_string(reasons, '; ') reasons from e where len(reasons) > 0",
    "p1_loaded": _PARSE + f"select line_id, {', '.join(f'v{i} {c}' for i, c in enumerate(_NAMES, 1))} from e where len(reasons) = 0",
    "p1_reason_counts": _PARSE + "select file_name, reason, count(*) n_lines from (select file_name, unnest(reasons) reason from e) group by 1, 2",
    "p2_found": f"""
with p as (select distinct box_id, t1, x1, y1 from prisms where not isnan(t1) and not isnan(x1) and not isnan(y1)),
g as (select *, cast(floor(t1 / {NEAR_DISTANCE}) as bigint) g from p),
s as (select *, unnest([g - 1, g, g + 1]) v from g)
select distinct 'near' rel, least(a.box_id, b.box_id) a_id, greatest(a.box_id, b.box_id) b_id
from g a join s b on a.g = b.v and a.box_id < b.box_id
where sqrt((a.t1 - b.t1) * (a.t1 - b.t1) + (a.x1 - b.x1) * (a.x1 - b.x1) + (a.y1 - b.y1) * (a.y1 - b.y1)) <= {NEAR_DISTANCE}
union all
select distinct 'inside', z.zone_id, p.box_id from p join zones z
on p.t1 >= z.t1 and p.t1 < z.t2 and p.x1 >= z.x1 and p.x1 < z.x2 and p.y1 >= z.y1 and p.y1 < z.y2""",
    "p2_zone_counts": """
select zone_id, count(distinct box_id) n_boxes from prisms p join zones z
on p.t1 >= z.t1 and p.t1 < z.t2 and p.x1 >= z.x1 and p.x1 < z.x2 and p.y1 >= z.y1 and p.y1 < z.y2
where not isnan(p.t1) and not isnan(p.x1) and not isnan(p.y1) group by 1""",
    "distance_join": f"""
with p as (select distinct box_id, t1 t, x1 x, y1 y from prisms where not isnan(t1) and not isnan(x1) and not isnan(y1)),
g as (select distinct id, t, x, y, cast(floor(t / {JOIN_DISTANCE}) as bigint) g from datapoints where not isnan(t) and not isnan(x) and not isnan(y)),
s as (select *, unnest([floor(t / {JOIN_DISTANCE})::bigint - 1, floor(t / {JOIN_DISTANCE})::bigint, floor(t / {JOIN_DISTANCE})::bigint + 1]) v from p)
select distinct g.id, s.box_id from g join s on g.g = s.v where sqrt((g.t - s.t) * (g.t - s.t) + (g.x - s.x) * (g.x - s.x) + (g.y - s.y) * (g.y - s.y)) <= {JOIN_DISTANCE}""",
    "regions_shared_edges": "select rec_id, 1::bigint n_regions from points where rec_id is not null",
    "p4_found": "select cell_id from datapoints where cell_id is not null group by 1 having count(*) * 50 >= (select count(*) from datapoints)",
    "p4_cells": f"""
select cell_id, count(*) n_rows, count(*) filter (t is not null and x is not null and y is not null and not isnan(t) and not isnan(x) and not isnan(y)) n_located,
{", ".join(f"{f}({c}) filter (not isnan({c})) {c}_{f}" for c in "txy" for f in ("min", "max"))},
count(data_value) n_values, cast(sum(data_value) as bigint) value_sum, cast(sum(data_value::bigint * data_value) as bigint) value_sumsq,
min(data_value) value_min, max(data_value) value_max, count(*) filter (data_value < 0) n_bin_00,
{", ".join(f"count(*) filter (data_value >= {e} and data_value < {e + 10}) n_bin_{i:02d}" for i, e in enumerate(range(0, 100, 10), 1))},
count(*) filter (data_value >= 100) n_bin_11 from datapoints group by 1""",
}
