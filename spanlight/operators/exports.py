"""Export streams: events, observations and traces with their scores, and what analytics tools are sent.

Scores are aggregated to the exported thing before they are joined, so a thing is one row however many scores it has. A score's name, numbers
and categories go into one JSON text a thing, sorted, so that two exports of the same rows are equal.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.functions.scalars import blank_to_null, key_sum, millis

from .tables import TRACE, latest_root

#: How far before an export's window the traces of its generations and scores are looked for.
LOOKBACK = dt.timedelta(days=7)


def within(time: str, start: dt.datetime, end: dt.datetime) -> Column:
    """A half-open window of time."""
    return (F.col(time) >= F.lit(start).cast("timestamp_ntz")) & (F.col(time) < F.lit(end).cast("timestamp_ntz"))


def json_list(*columns: str | Column) -> Column:
    """An aggregate: the distinct rows of some columns as a JSON list."""
    return F.to_json(F.array_sort(F.collect_set(F.struct(*columns))))


def label_list(key: str, value: str | Column, separator: str = ",") -> Column:
    """An aggregate: key:value texts, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col(key), value))), separator)


def scores_by(scores: DataFrame, *keys: str) -> DataFrame:
    """(keys, scores): the averages of numeric scores and the categories of others as a JSON list, one row a key."""
    numbers = scores.where("data_type <> 'CATEGORICAL'").groupBy(*keys, "name").agg(F.format_string("%.4f", F.round(F.avg("value") + 1e-9, 4)).alias("value"))
    labels = scores.where("data_type = 'CATEGORICAL' and string_value is not null").select(*keys, "name", F.col("string_value").alias("value"))
    return numbers.unionByName(labels).groupBy(*keys).agg(json_list("name", "value").alias("scores"))


def event_stream(spans: DataFrame, scores: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Every span that started in a window, with the scores of its own."""
    own = scores_by(scores.where("observation_id is not null"), "trace_id", "observation_id").withColumnRenamed("observation_id", "span_id")
    rows = spans.where(within("start_time", start, end)).join(own, ["trace_id", "span_id"], "left")
    return rows.select(*TRACE, "span_id", blank_to_null("parent_span_id").alias("parent_span_id"), "type", "name", "level", "start_time", "end_time", millis("start_time", "end_time").alias("latency_ms"),
                       millis("start_time", "completion_start_time").alias("ttft_ms"), "total_cost", "scores")


def observation_stream(spans: DataFrame, scores: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Observations (spans below a root) of a window, their newest version each, with usage and the name of their trace."""
    rows = spans.where(within("start_time", start, end) & (F.coalesce("parent_span_id", F.lit("")) != ""))
    rest = [c for c in ("parent_span_id", "type", "name", "level", "start_time", "end_time", "completion_start_time", "provided_model_name", "total_cost")]
    newest = rows.select(*TRACE, "span_id", "event_ts", *rest, key_sum("usage_details", "input").alias("input_tokens"), key_sum("usage_details", "output").alias("output_tokens"))
    newest = newest.groupBy(*TRACE, "span_id").agg(F.max(F.struct("event_ts", *rest, "input_tokens", "output_tokens")).alias("x")).select(*TRACE, "span_id", "x.*")
    own = scores_by(scores.where("observation_id is not null"), "trace_id", "observation_id").withColumnRenamed("observation_id", "span_id")
    traces = latest_root(spans.where(within("start_time", start - LOOKBACK, end))).select(*TRACE, F.col("name").alias("trace_name"))
    return newest.join(own, ["trace_id", "span_id"], "left").join(traces, list(TRACE), "left").select(
        *TRACE, "span_id", "parent_span_id", "type", "name", "trace_name", "level", "start_time", millis("start_time", "end_time").alias("latency_ms"), millis("start_time", "completion_start_time").alias("ttft_ms"),
        F.col("provided_model_name").alias("model"), "input_tokens", "output_tokens", "total_cost", "scores")


def trace_stream(spans: DataFrame, scores: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Traces whose newest root started in a window, with totals over their spans and with all their scores."""
    wanted = latest_root(spans).where(within("start_time", start, end))
    totals = spans.join(wanted.select(*TRACE), list(TRACE), "left_semi").groupBy(*TRACE).agg(
        F.count_if(F.coalesce("parent_span_id", F.lit("")) != "").alias("n_observations"), F.sum("total_cost").alias("_cost"), F.min("start_time").alias("_first"), F.max("end_time").alias("_last"))
    return wanted.join(totals, list(TRACE), "left").join(scores_by(scores, "trace_id"), "trace_id", "left").select(
        *TRACE, "name", "start_time", blank_to_null("user_id").alias("user_id"), blank_to_null("session_id").alias("session_id"), "release", "version", "environment", F.array_sort("tags").alias("tags"),
        "n_observations", F.col("_cost").alias("total_cost"), millis("_first", "_last").alias("latency_ms"), "scores")


def analytics_traces(spans: DataFrame, start: dt.datetime, end: dt.datetime, url: str = "") -> DataFrame:
    """What an analytics tool is sent of a window's traces: who, what, how many and how dear."""
    out = trace_stream(spans, spans.sparkSession.createDataFrame([], "trace_id string, name string, data_type string, value double, string_value string"), start, end)
    return out.select(F.col("trace_id").alias("id"), "project_id", "user_id", "session_id", "name", F.col("start_time").alias("timestamp"), "release", "version", "n_observations", "total_cost", html_path(url).alias("url"))


def analytics_generations(spans: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """A window's generations with their trace's name, user and session; traces are looked for as far back as LOOKBACK."""
    traces = latest_root(spans.where(within("start_time", start - LOOKBACK, end))).select(*TRACE, F.col("name").alias("_trace_name"), blank_to_null("user_id").alias("trace_user"), blank_to_null("session_id").alias("trace_session"))
    rows = spans.where(within("start_time", start, end) & (F.col("type") == "GENERATION"))
    return rows.join(traces, list(TRACE), "left").select(
        F.col("span_id").alias("id"), "project_id", "trace_id", F.col("_trace_name").alias("trace_name"), F.col("trace_user").alias("user_id"), F.col("trace_session").alias("session_id"), F.col("start_time").alias("timestamp"),
        F.col("provided_model_name").alias("model"), millis("start_time", "end_time").alias("latency_ms"), millis("start_time", "completion_start_time").alias("ttft_ms"), "total_cost")


def analytics_scores(scores: DataFrame, spans: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """A window's scores with their trace's name and user."""
    traces = latest_root(spans.where(within("start_time", start - LOOKBACK, end))).select("trace_id", F.col("name").alias("trace_name"), blank_to_null("user_id").alias("user_id"))
    return scores.where(within("timestamp", start, end)).join(traces, "trace_id", "left").select("id", "trace_id", "trace_name", "user_id", "name", "source", "data_type", "value", "string_value", "timestamp")


def html_path(base: str = "") -> Column:
    """The path of a trace's page."""
    return F.concat(F.lit(f"{base}/project/"), "project_id", F.lit("/traces/"), "trace_id")
