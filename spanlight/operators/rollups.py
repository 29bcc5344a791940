"""Fixed reports: daily metrics, prompt metrics, score aggregates, costs and counts by tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlight.functions.scalars import key_sum, millis, path

from .tables import TRACE, roots
from .timeseries import bucket


def daily_metrics(spans: DataFrame) -> DataFrame:
    """Traces, observations and cost by day and project."""
    by = ("project_id", F.to_date("start_time").alias("day"))
    return spans.groupBy(*by).agg(
        F.count_distinct(F.when(F.col("parent_span_id") == "", F.col("trace_id"))).alias("n_traces"), F.count_if(F.col("parent_span_id") != "").alias("n_observations"),
        F.coalesce(F.sum("total_cost"), F.lit(0)).alias("total_cost"))


def daily_usage(spans: DataFrame) -> DataFrame:
    """Usage and cost by day and model."""
    rows = spans.where(F.col("provided_model_name").isNotNull())
    return rows.groupBy(F.to_date("start_time").alias("day"), F.col("provided_model_name").alias("model")).agg(
        F.count(F.lit(1)).alias("n_observations"), F.count_distinct("trace_id").alias("n_traces"), F.sum(key_sum("usage_details", "input")).cast("bigint").alias("input_usage"),
        F.sum(key_sum("usage_details", "output")).cast("bigint").alias("output_usage"), F.sum("total_cost").alias("total_cost"))


def prompt_metrics(spans: DataFrame) -> DataFrame:
    """Counts, first and last use and medians by prompt version."""
    rows = spans.where(F.col("prompt_name").isNotNull())
    half = lambda c: F.percentile(c, F.lit(0.5))
    return rows.groupBy("prompt_name", "prompt_version").agg(
        F.count(F.lit(1)).alias("n"), F.min("start_time").alias("first_at"), F.max("start_time").alias("last_at"), half(millis("start_time", "end_time")).alias("median_latency_ms"),
        half(key_sum("usage_details", "input").cast("double")).alias("median_input"), half(key_sum("usage_details", "output").cast("double")).alias("median_output"), half(F.col("total_cost").cast("double")).alias("median_cost"))


def score_aggregate(scores: DataFrame) -> DataFrame:
    """Scores by name, source and type, most frequent first."""
    return scores.groupBy("name", "source", "data_type").agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("avg")).orderBy(F.col("count").desc(), "name", "source", "data_type")


def score_aggregate_merged(scores: DataFrame) -> DataFrame:
    """Numeric averages and counts of categories in one list, most frequent first."""
    numeric = scores.where(F.col("data_type") != "CATEGORICAL").groupBy("name", "source", "data_type").agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("avg")).withColumn("string_value", F.lit(None).cast("string"))
    labels = scores.where(F.col("data_type") == "CATEGORICAL").groupBy("name", "source", "data_type", "string_value").agg(F.count(F.lit(1)).alias("count")).withColumn("avg", F.lit(None).cast("double"))
    return numeric.unionByName(labels).orderBy(F.col("count").desc(), "name", "source", "data_type", "string_value")


def usage_by_time(spans: DataFrame, column: str, granularity: str) -> DataFrame:
    """A map column's values by bucket and key: one explode, no position join."""
    rows = spans.select(bucket("start_time", granularity).alias("time_dimension"), F.explode(column).alias("key", "v"))
    return rows.groupBy("time_dimension", "key").agg(F.sum("v").alias("value"))


def trace_costs(spans: DataFrame) -> DataFrame:
    """Cost and latency of each trace over all its spans."""
    return spans.groupBy(*TRACE).agg(F.sum("total_cost").alias("total_cost"), F.min("start_time").alias("first_at"), F.max("end_time").alias("last_at")).withColumn("latency_ms", millis("first_at", "last_at")).drop("first_at", "last_at")


def cost_by_metadata(spans: DataFrame, key: str) -> DataFrame:
    """Average and total cost and count by a metadata value."""
    rows = spans.withColumn("group", F.col("metadata")[key]).where("group is not null")
    return rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("total_cost").alias("total_cost"), F.avg("total_cost").alias("avg_cost"))


def counts_by_project(spans: DataFrame, scores: DataFrame, start, end) -> DataFrame:
    """Stored things of each project in a half-open range of time; scores count for their trace's project."""
    within = lambda c: (F.col(c) >= F.lit(start).cast("timestamp_ntz")) & (F.col(c) < F.lit(end).cast("timestamp_ntz"))
    things = spans.where(within("start_time")).groupBy("project_id").agg(F.count_if(F.col("parent_span_id") == "").alias("n_traces"), F.count_if(F.col("parent_span_id") != "").alias("n_observations"))
    per_trace = scores.where(within("timestamp")).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))
    of_scores = per_trace.join(roots(spans).select("trace_id", "project_id"), "trace_id").groupBy("project_id").agg(F.sum("n").alias("n_scores"))
    return things.join(of_scores, "project_id", "full_outer").select("project_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_traces", "n_observations", "n_scores")))


def field_sizes(df: DataFrame, *columns: str) -> DataFrame:
    """The average length of text columns; NULL counts as 0."""
    return df.agg(*(F.avg(F.coalesce(F.length(F.col(c).cast("string")), F.lit(0))).alias(f"avg_{c}") for c in columns))


def json_field_counts(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Rows by the value at a dotted path of a JSON column."""
    return df.groupBy(path(column, *keys).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def pivot_report(df: DataFrame, rows: list[str], value: str) -> DataFrame:
    """A pivot table with subtotals at every level, exact because they are aggregated from the rows: level 0 is the total."""
    out = df.rollup(*rows).agg(F.sum(value).alias("sum"), F.avg(value).alias("avg"), F.count(value).alias("count"), *(F.grouping(c).alias(f"_g_{c}") for c in rows))
    depth = sum((1 - F.col(f"_g_{c}") for c in rows), F.lit(0))
    return out.select(depth.cast("int").alias("depth"), *rows, "sum", "avg", "count")


def pivot_sorted(report: DataFrame, rows: list[str], by: str = "sum", descending: bool = True) -> DataFrame:
    """A pivot table in display order: groups by their subtotal, each one's subtotal before its parts, and the total first."""
    way = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_last())
    out, order = report, []
    for i in range(len(rows)):
        head = report.where(F.col("depth") == i + 1).select(*(F.col(c).alias(f"_k_{c}") for c in rows[: i + 1]), F.col(by).alias(f"_by_{i}"))
        out = out.join(head, (F.col("depth") > i) & F.lit(True) & _all_equal(rows[: i + 1]), "left").drop(*(f"_k_{c}" for c in rows[: i + 1]))
        order += [(F.col("depth") > i).asc(), way(F.col(f"_by_{i}")), F.col(rows[i]).asc_nulls_first()]
    return out.orderBy(*order).select(*report.columns)


def _all_equal(rows: list[str]):
    out = F.lit(True)
    for c in rows:
        out = out & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return out


def distinct_links(items: DataFrame, *columns: str) -> DataFrame:
    """How many distinct combinations of columns there are; one with a NULL in it does not count."""
    return items.agg(F.count_distinct(*columns).alias("n"))


def change_counts(changes: DataFrame, *keys: str) -> DataFrame:
    """Upserts and deletes by key, of rows with a flag ``is_deleted``."""
    return changes.groupBy(*keys).agg(F.count_if(~F.col("is_deleted")).alias("n_upserted"), F.count_if(F.col("is_deleted")).alias("n_deleted"), F.count(F.lit(1)).alias("n_changes"))
