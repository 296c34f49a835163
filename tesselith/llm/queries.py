"""Queries of the operators for training data, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.llm import bisection, mixture, packing, pagespam, reservoir, tokens
from tesselith.session import cut
from tesselith.sources.tables import table

PERMILLE = (10, 50, 250, 500, 750, 900, 950, 990)
SAMPLE_SIZE, SAMPLE_SLOTS, SEED = 5_000, 500, 20_240_101
#: Seconds between the batches in which points arrive.
ARRIVALS = 5 * 86_400.0


def p3_percentiles(spark: SparkSession, base: str) -> DataFrame:
    return bisection.percentiles(table(spark, base, "range_values"), "query_field", "field_value", PERMILLE)


def p3_day_summaries(spark: SparkSession, base: str) -> DataFrame:
    return bisection.summaries(table(spark, base, "range_values"), "query_field", "field_value", ["run_day"])


def p3_merged(spark: SparkSession, base: str) -> DataFrame:
    merged = bisection.merge(p3_day_summaries(spark, base), "query_field")
    return bisection.bounds(merged, "query_field", PERMILLE).drop("skipped")


def p3_check(spark: SparkSession, base: str) -> DataFrame:
    """Whether the exact values lie within the bounds that merged summaries of days give, and these within the stated error."""
    bounds = p3_merged(spark, base).withColumnRenamed("n", "m")
    exact = p3_percentiles(spark, base).withColumnRenamed("query_field", "f")
    both = exact.join(bounds, F.col("f").eqNullSafe(F.col("query_field")) & (exact["permille"] == bounds["permille"])).drop(bounds["permille"])
    near = F.col("high") - F.col("low") <= 0.0055 * F.greatest(F.abs("low"), F.abs("high"))
    holds = (F.col("m") == F.col("n")) & (F.col("low") <= F.col("value")) & (F.col("value") <= F.col("high")) & near
    return both.select("query_field", "permille", "n", holds.alias("holds"))


def p5_sample(spark: SparkSession, base: str) -> DataFrame:
    """Played batch by batch, as the pieces arrive; how many follow is known to none of the batches."""
    points = table(spark, base, "points")
    return reservoir.reservoir_sample(points, SAMPLE_SIZE, "arrived_at", ["rec_id", "t", "x", "piece_id"], ARRIVALS, SEED, SAMPLE_SLOTS).drop("slot")


def p5_check(spark: SparkSession, base: str) -> DataFrame:
    """Of a sample: rows, different records, records that points doesn't hold as they are, partitions of slots that aren't full."""
    points = table(spark, base, "points").select("rec_id", "t", "x", "piece_id")
    drawn = cut(reservoir.reservoir_sample(table(spark, base, "points"), SAMPLE_SIZE, "arrived_at", points.columns, ARRIVALS, SEED, SAMPLE_SLOTS))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) for c in points.columns]
    foreign = drawn.alias("d").join(points.alias("p"), same, "left_anti").count()
    slots = drawn.groupBy(F.floor(F.col("slot") / SAMPLE_SLOTS).alias("p")).agg(F.countDistinct("slot").alias("n")).where(F.col("n") == SAMPLE_SLOTS).count()
    return drawn.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("rec_id").alias("n_ids"), F.lit(foreign).cast("bigint").alias("n_foreign"), F.lit(slots).cast("bigint").alias("full_parts"))


def _packed(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents")
    shards = max(1, -(-docs.count() // packing.SHARD_ROWS))
    return packing.pack(docs.select("doc_id", tokens.token_count(F.col("text")).alias("n_tokens")), table(spark, base, "containers"), shards)


def p6_packed(spark: SparkSession, base: str) -> DataFrame:
    return _packed(spark, base)


def p6_fill(spark: SparkSession, base: str) -> DataFrame:
    return packing.fill_report(_packed(spark, base), table(spark, base, "containers"))


def p6_check(spark: SparkSession, base: str) -> DataFrame:
    """Per kind: texts placed, whether their tokens are conserved, containers beyond the capacity, texts split though they
    fit or not in pieces that follow each other, and split texts whose pieces don't make up the text."""
    docs = table(spark, base, "documents").select("doc_id", "text")
    packed = cut(_packed(spark, base))
    kinds = table(spark, base, "containers").where("capacity_tokens >= 1 and container_kind is not null").select("container_kind", "capacity_tokens")
    sizes = cut(docs.select("doc_id", tokens.token_count(F.col("text")).alias("size")).where("size is not null"))
    total = sizes.agg(F.sum("size")).first()[0]
    end = F.max(F.col("token_start") + F.col("n_tokens"))
    texts = packed.groupBy("container_kind", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"), end.alias("end"), F.countDistinct("token_start").alias("starts"))
    texts = texts.join(F.broadcast(kinds), "container_kind").join(sizes, "doc_id", "left")
    sound = (F.col("n") == F.col("size")) & (F.col("end") == F.col("size")) & (F.col("starts") == F.col("pieces")) & (F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity_tokens"))))
    per_text = texts.groupBy("container_kind").agg(F.count(F.lit(1)).alias("n_docs"), (F.sum("n") == total).alias("conserved"), F.count_if(~F.coalesce(sound, F.lit(False))).alias("wrong_splits"))
    used = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("used")).join(F.broadcast(kinds), "container_kind")
    over = used.groupBy("container_kind").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("overfull"))
    split = packed.join(texts.where("pieces > 1").select("container_kind", "doc_id"), ["container_kind", "doc_id"], "left_semi")
    joined = packing.texts_of(split, docs).groupBy("container_kind", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "text"))), lambda p: p["text"]), "").alias("whole"))
    torn = joined.join(docs, "doc_id").groupBy("container_kind").agg(F.count_if(F.col("whole") != F.col("text")).alias("torn"))
    out = per_text.join(over, "container_kind").join(torn, "container_kind", "left")
    return out.select("container_kind", "n_docs", "conserved", "wrong_splits", "overfull", F.coalesce("torn", F.lit(0)).cast("bigint").alias("torn"))


def _mixed(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, base, "source_targets")
    named = targets.where("source is not null").select("source").distinct()
    docs = table(spark, base, "documents").join(F.broadcast(named.limit(mixture.MAX_SOURCES)), "source", "left_semi")
    sized = docs.select("doc_id", "source", tokens.token_count(F.col("text")).alias("n_tokens"), F.xxhash64(F.lit(SEED), F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())).alias("u"))
    return mixture.mix(cut(sized), targets)


def p7_mix(spark: SparkSession, base: str) -> DataFrame:
    return _mixed(spark, base)[0]


def p7_shares(spark: SparkSession, base: str) -> DataFrame:
    return _mixed(spark, base)[1]


def p7_check(spark: SparkSession, base: str) -> DataFrame:
    """Per source of the targets: no record beyond the limit of repetitions, the size within one record of the plan (or all
    that the limit allows), the shares reached add up, and every chosen record is one of the source's documents."""
    chosen, report = _mixed(spark, base)
    chosen = cut(chosen)
    docs = table(spark, base, "documents").select(F.col("doc_id").alias("d"), F.col("source").alias("s"))
    foreign = chosen.join(docs, (F.col("d") == F.col("doc_id")) & (F.col("s") == F.col("source")), "left_anti").count()
    most = chosen.groupBy("source").agg(F.max("repeats").alias("most"), F.max("n_tokens").alias("largest"), F.count(F.lit(1)).alias("rows"), F.countDistinct("doc_id").alias("ids"))
    both = report.join(most, "source", "left")
    within = F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)) & F.coalesce(F.col("rows") == F.col("ids"), F.lit(True))
    planned = F.abs(F.col("used_tokens") - F.col("planned_tokens")) <= F.coalesce("largest", F.lit(0)) + 1e-6
    return both.select("source", within.alias("within_limit"), planned.alias("as_planned"), F.lit(foreign == 0).alias("own_records"))


def p8_check(spark: SparkSession, base: str) -> DataFrame:
    """Rows of the pages' figures, and how many contradict each other or their text."""
    pages = p8_pages(spark, base).withColumnRenamed("n_chars", "own_chars")
    both = pages.join(table(spark, base, "documents").select("doc_id", "text", "n_chars"), "doc_id")
    wrong = (F.col("promo_chars") > F.col("own_chars")) | (F.col("own_chars") > F.coalesce("n_chars", F.lit(0))) | (F.col("flagged") & (F.coalesce(F.length("text"), F.lit(0)) == 0))
    wrong = wrong | ((F.col("n_shapes") > 0) != (F.col("promo_lines") > 0)) | (F.col("n_shapes") > F.col("promo_lines"))
    return both.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(wrong).alias("n_wrong"))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return pagespam.page_shapes(table(spark, base, "documents")).where("flagged").select("doc_id")


def p8_pages(spark: SparkSession, base: str) -> DataFrame:
    return pagespam.page_shapes(table(spark, base, "documents"))


QUERIES = {f.__name__: f for f in (p3_percentiles, p3_day_summaries, p3_merged, p3_check, p5_sample, p5_check, p6_packed, p6_fill, p6_check, p7_mix, p7_shares, p7_check, p8_found, p8_pages, p8_check)}

#: The values of a percentile's row in the tables.
_RANKED = f"""with v as (select query_field, field_value + 0.0 field_value from range_values where field_value is not null and not isnan(field_value)),
r as (select *, row_number() over (partition by query_field order by field_value) i, count(*) over (partition by query_field) n from v),
p as (select cast(unnest([{", ".join(map(str, PERMILLE))}]) as integer) permille)
"""

ORACLES = {
    "p5_check": f"""select least(count(*), {SAMPLE_SIZE})::bigint n_rows, least(count(*), {SAMPLE_SIZE})::bigint n_ids, 0::bigint n_foreign,
case when count(*) >= {SAMPLE_SIZE} then {SAMPLE_SIZE // SAMPLE_SLOTS} else 0 end::bigint full_parts from points""",
    "p3_percentiles": _RANKED + "select query_field, permille, n, field_value as value from r join p on i = greatest(1, (permille * n + 999) // 1000)",
    "p3_check": _RANKED + "select query_field, permille, n, true as holds from r join p on i = greatest(1, (permille * n + 999) // 1000)",
    "p6_check": """select distinct container_kind, (select count(*) from documents where text is not null)::bigint n_docs, true as conserved, 0::bigint wrong_splits, 0::bigint overfull, 0::bigint torn
from containers where capacity_tokens >= 1 and container_kind is not null""",
    "p7_check": "select distinct source, true as within_limit, true as as_planned, true as own_records from source_targets where source is not null",
    "p8_check": "select count(*)::bigint n_docs, 0::bigint n_wrong from documents",
}
