"""Export streams, public filters, late additions to tables and analytics, and ingestion rules as named queries."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from spanlight.operators import exports, public_api, rollups, tables
from spanlight.operators import score_analytics as sa
from spanlight.sources import otel, star
from spanlight.sources.star import oracle
from spanlight.streaming import ingest

from . import metrics
from .registry import query, r4

START, END = dt.datetime(1995, 1, 1), dt.datetime(1995, 7, 1)
_IN = "start_time >= TIMESTAMP '1995-01-01' AND start_time < TIMESTAMP '1995-07-01'"


def _scores(keys: str, where: str = "true") -> str:
    return f"""sc AS (SELECT {keys}, '[' || string_agg('{{"name":"' || name || '","value":"' || v || '"}}', ',' ORDER BY name, v) || ']' AS scores FROM (
  SELECT {keys}, name, printf('%.4f', {r4('avg(value)')}) AS v FROM scores WHERE data_type <> 'CATEGORICAL' AND {where} GROUP BY ALL
  UNION SELECT {keys}, name, string_value FROM scores WHERE data_type = 'CATEGORICAL' AND {where}) GROUP BY {keys})"""


@query("export_events", oracle(f"""SELECT project_id, s.trace_id, span_id, nullif(parent_span_id, '') AS parent_span_id, type, name, level, start_time, end_time, date_sub('millisecond', start_time, end_time) AS latency_ms,
  date_sub('millisecond', start_time, completion_start_time) AS ttft_ms, {r4('total_cost')} AS total_cost, scores FROM spans s LEFT JOIN sc ON s.trace_id = sc.trace_id AND span_id = observation_id WHERE {_IN}""", _scores("trace_id, observation_id", "observation_id IS NOT NULL")))
def _events(spark, sf_dir):
    return exports.event_stream(star.spans(spark, sf_dir), star.scores(spark, sf_dir), START, END)


@query("export_observations", oracle(f"""SELECT c.project_id, c.trace_id, c.span_id, c.parent_span_id, c.type, c.name, r.name AS trace_name, c.level, c.start_time, date_sub('millisecond', c.start_time, c.end_time) AS latency_ms,
  date_sub('millisecond', c.start_time, c.completion_start_time) AS ttft_ms, c.provided_model_name AS model, (c.u_input + c.u_cache)::DOUBLE AS input_tokens, c.u_output::DOUBLE AS output_tokens, {r4('c.total_cost')} AS total_cost, scores
  FROM child c LEFT JOIN (SELECT * FROM root WHERE start_time >= TIMESTAMP '1994-12-25' AND start_time < TIMESTAMP '1995-07-01') r USING (project_id, trace_id) LEFT JOIN sc ON c.trace_id = sc.trace_id AND c.span_id = observation_id
  WHERE c.start_time >= TIMESTAMP '1995-01-01' AND c.start_time < TIMESTAMP '1995-07-01'""", _scores("trace_id, observation_id", "observation_id IS NOT NULL")))
def _observations(spark, sf_dir):
    return exports.observation_stream(star.spans(spark, sf_dir), star.scores(spark, sf_dir), START, END)


_TOTALS = "tot AS (SELECT project_id, trace_id, count(*) FILTER (parent_span_id <> '') AS n, sum(total_cost) AS cost, min(start_time) AS a, max(end_time) AS b FROM spans GROUP BY 1, 2)"


@query("export_traces", oracle(f"""SELECT r.project_id, r.trace_id, name, start_time, nullif(user_id, '') AS user_id, nullif(session_id, '') AS session_id, release, version, environment, list_sort(tags) AS tags, n AS n_observations, {r4('cost')} AS total_cost,
  date_sub('millisecond', a, b) AS latency_ms, scores FROM root r LEFT JOIN tot USING (project_id, trace_id) LEFT JOIN sc ON r.trace_id = sc.trace_id WHERE {_IN}""", _TOTALS, _scores("trace_id")))
def _traces(spark, sf_dir):
    return exports.trace_stream(star.spans(spark, sf_dir), star.scores(spark, sf_dir), START, END)


@query("analytics_traces", oracle(f"""SELECT trace_id AS id, project_id, nullif(user_id, '') AS user_id, nullif(session_id, '') AS session_id, name, start_time AS timestamp, release, version, n AS n_observations, {r4('cost')} AS total_cost,
  'https://host/project/' || project_id || '/traces/' || trace_id AS url FROM root LEFT JOIN tot USING (project_id, trace_id) WHERE {_IN}""", _TOTALS))
def _analytics_traces(spark, sf_dir):
    return exports.analytics_traces(star.spans(spark, sf_dir), START, END, "https://host")


@query("analytics_generations", oracle(f"""SELECT c.span_id AS id, c.project_id, c.trace_id, r.name AS trace_name, nullif(r.user_id, '') AS user_id, nullif(r.session_id, '') AS session_id, c.start_time AS timestamp, c.provided_model_name AS model,
  date_sub('millisecond', c.start_time, c.end_time) AS latency_ms, date_sub('millisecond', c.start_time, c.completion_start_time) AS ttft_ms, {r4('c.total_cost')} AS total_cost
  FROM child c LEFT JOIN (SELECT * FROM root WHERE start_time >= TIMESTAMP '1994-12-25' AND start_time < TIMESTAMP '1995-07-01') r USING (project_id, trace_id) WHERE c.type = 'GENERATION' AND c.start_time >= TIMESTAMP '1995-01-01' AND c.start_time < TIMESTAMP '1995-07-01'"""))
def _analytics_generations(spark, sf_dir):
    return exports.analytics_generations(star.spans(spark, sf_dir), START, END)


@query("analytics_scores", oracle(f"""SELECT s.id, s.trace_id, r.name AS trace_name, nullif(r.user_id, '') AS user_id, s.name, source, data_type, {r4('value')} AS value, string_value, timestamp FROM scores s
  LEFT JOIN (SELECT * FROM root WHERE start_time >= TIMESTAMP '1992-12-25' AND start_time < TIMESTAMP '2024-02-01') r USING (trace_id) WHERE timestamp >= TIMESTAMP '1993-01-01' AND timestamp < TIMESTAMP '2024-02-01'"""))
def _analytics_scores(spark, sf_dir):
    return exports.analytics_scores(star.scores(spark, sf_dir), star.spans(spark, sf_dir), dt.datetime(1993, 1, 1), dt.datetime(2024, 2, 1))


@query("score_labels", oracle("SELECT trace_id, string_agg(name || ':' || string_value, ',' ORDER BY name || ':' || string_value) AS labels FROM scores WHERE string_value IS NOT NULL GROUP BY 1"))
def _labels(spark, sf_dir):
    return star.scores(spark, sf_dir).where("string_value is not null").groupBy("trace_id").agg(exports.label_list("name", "string_value").alias("labels"))


@query("public_filters", oracle("SELECT trace_id, span_id FROM spans WHERE user_id = 'u41' AND level IN ('WARNING', 'ERROR') AND name <> 'x' AND start_time >= TIMESTAMP '1994-01-01'"))
def _public(spark, sf_dir):
    simple = {"userId": ("userId", "string", "="), "level": ("level", "stringOptions", "any of"), "name": ("name", "string", "="), "fromStartTime": ("startTime", "datetime", ">="), "version": ("version", "string", "=")}
    columns = {"userId": "user_id", "level": "level", "name": "name", "startTime": "start_time", "version": "version"}
    asked = {"userId": "u41", "level": ["DEFAULT"], "fromStartTime": "1994-01-01T00:00:00", "version": "", "other": 1,
             "filter": json.dumps([{"type": "stringOptions", "column": "level", "operator": "any of", "value": ["WARNING", "ERROR"]}, {"type": "stringOptions", "column": "name", "operator": "none of", "value": ["x"]}])}
    return public_api.where(star.spans(spark, sf_dir), asked, simple, columns).select("trace_id", "span_id")


@query("public_field_groups", oracle(f"SELECT project_id, trace_id, span_id, parent_span_id, type, start_time, end_time, provided_model_name, prompt_name, prompt_version FROM child WHERE {_IN}"))
def _groups(spark, sf_dir):
    return public_api.field_groups(star.child_spans(spark, sf_dir).where(exports.within("start_time", START, END)), ["model", "prompt"])


@query("metrics_raw_filter", oracle("SELECT level, count(*) AS sum_count FROM spans WHERE start_time >= TIMESTAMP '1990-01-01' AND (length(name) = 6 OR level = 'ERROR') GROUP BY 1"))
def _raw(spark, sf_dir):
    spec = {"view": "observations", "dimensions": [{"field": "level"}], "metrics": [{"measure": "count", "aggregation": "sum"}], "fromTimestamp": "1990-01-01", "toTimestamp": "2030-01-01", "rawFilter": "length(name) = 6 OR level = 'ERROR'"}
    return metrics.compile_query(spec, {"spans": star.spans(spark, sf_dir), "scores": star.scores(spark, sf_dir)}, trusted=True)


@query("metrics_left_relation", oracle("""SELECT provided_model_name AS "providedModelName", coalesce(sum(n), 0)::BIGINT AS "sum_countScores", count(*) AS sum_count FROM spans LEFT JOIN (
  SELECT observation_id, count(*) AS n FROM scores WHERE observation_id IS NOT NULL GROUP BY 1) ON span_id = observation_id GROUP BY 1"""))
def _left(spark, sf_dir):
    spec = {"view": "observations", "dimensions": [{"field": "providedModelName"}], "metrics": [{"measure": "countScores", "aggregation": "sum"}, {"measure": "count", "aggregation": "sum"}]}
    return metrics.compile_query(spec, {"spans": star.spans(spark, sf_dir), "scores": star.scores(spark, sf_dir)})


@query("metrics_blank_users", oracle("SELECT nullif(user_id, '') AS \"userId\", count(*) AS sum_count FROM root GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 20"))
def _blank(spark, sf_dir):
    spec = {"view": "traces", "dimensions": [{"field": "userId"}], "metrics": [{"measure": "count", "aggregation": "sum"}], "fromTimestamp": "1990-01-01", "toTimestamp": "2030-01-01", "orderBy": [{"field": "sum_count", "direction": "desc"}], "rowLimit": 20}
    return metrics.compile_query(spec, {"spans": star.spans(spark, sf_dir), "scores": star.scores(spark, sf_dir)})


@query("page_with_total", oracle("SELECT trace_id, span_id, start_time, row_number() OVER (ORDER BY start_time DESC, trace_id DESC, span_id DESC) AS row_number, (SELECT count(*) FROM spans) AS total FROM spans ORDER BY start_time DESC, trace_id DESC, span_id DESC LIMIT 20 OFFSET 40"))
def _page(spark, sf_dir):
    rows = star.spans(spark, sf_dir).select("trace_id", "span_id", "start_time")
    return tables.page_with_total(rows, [F.col(c).desc() for c in ("start_time", "trace_id", "span_id")], 2, 20)


@query("trace_default_order", oracle("SELECT trace_id, start_time FROM root ORDER BY start_time::DATE DESC, start_time DESC, event_ts DESC, trace_id LIMIT 40"))
def _default_order(spark, sf_dir):
    return star.root_spans(spark, sf_dir).orderBy(*tables.default_order(), "trace_id").limit(40).select("trace_id", "start_time")


@query("limit_before_join", oracle("SELECT id, r.name AS trace_name FROM (SELECT * FROM scores ORDER BY timestamp DESC, id LIMIT 50) s JOIN root r USING (trace_id)"))
def _limited(spark, sf_dir):
    names = star.root_spans(spark, sf_dir).select("trace_id", F.col("name").alias("trace_name"))
    return tables.limited_then_joined(star.scores(spark, sf_dir).select("id", "trace_id", "timestamp"), [F.col("timestamp").desc(), F.col("id")], 50, names, ["trace_id"], "inner").select("id", "trace_name")


@query("any_error", oracle("SELECT project_id, trace_id, bool_or(level = 'ERROR') AS flag FROM spans GROUP BY 1, 2"))
def _any(spark, sf_dir):
    return tables.any_true(star.spans(spark, sf_dir), F.col("level") == "ERROR", "project_id", "trace_id")


@query("session_metrics", oracle(f"""SELECT project_id, session_id, min(start_time) AS first_at, max(start_time) AS last_at, list_sort(list_distinct(list(trace_id))) AS trace_ids, coalesce(list_sort(list_distinct(list(nullif(user_id, '')))), []) AS user_ids,
  list_sort(list_distinct(flatten(list(tags)))) AS tags, {r4('sum(total_cost)')} AS total_cost FROM spans WHERE coalesce(session_id, '') <> '' GROUP BY 1, 2"""))
def _session_metrics(spark, sf_dir):
    return tables.session_metrics(star.spans(spark, sf_dir))


@query("since_first_item", oracle("SELECT span_id FROM child WHERE start_time >= (SELECT min(created_at) - INTERVAL 1 DAY FROM run_items WHERE created_at > TIMESTAMP '1998-01-01')"))
def _since(spark, sf_dir):
    return tables.since_first(star.child_spans(spark, sf_dir), "start_time", star.run_items(spark, sf_dir).where("created_at > timestamp_ntz '1998-01-01'"), "created_at").select("span_id")


@query("pivot_sorted", oracle(f"""SELECT depth, environment, level, {r4('s')} AS sum FROM (SELECT 2 - grouping(environment) - grouping(level) AS depth, environment, level, sum(total_cost) AS s FROM child GROUP BY ROLLUP (environment, level))
  ORDER BY depth > 0, max(CASE WHEN depth = 1 THEN s END) OVER (PARTITION BY environment, depth > 0) DESC NULLS LAST, environment NULLS FIRST, depth > 1, s DESC NULLS LAST, level NULLS FIRST LIMIT 6"""))
def _pivot_sorted(spark, sf_dir):
    report = rollups.pivot_report(star.child_spans(spark, sf_dir), ["environment", "level"], "total_cost")
    return rollups.pivot_sorted(report, ["environment", "level"]).limit(6).select("depth", "environment", "level", "sum")


@query("distinct_links", oracle("SELECT count(*) AS n FROM (SELECT DISTINCT project_id, dataset_id, run_id, item_id FROM run_items)"))
def _distinct_links(spark, sf_dir):
    return rollups.distinct_links(star.run_items(spark, sf_dir), "project_id", "dataset_id", "run_id", "item_id")


@query("change_counts", "SELECT l_linestatus, count(*) FILTER (l_returnflag <> 'R') AS n_upserted, count(*) FILTER (l_returnflag = 'R') AS n_deleted, count(*) AS n_changes FROM lineitem GROUP BY 1")
def _changes(spark, sf_dir):
    return rollups.change_counts(star.table(spark, sf_dir, "lineitem").withColumn("is_deleted", F.col("l_returnflag") == "R"), "l_linestatus")


@query("score_filled_categories", oracle("SELECT category, (SELECT count(*) FROM scores WHERE name = 'error' AND string_value = category AND event_id % 11 = 0 AND string_value = 'True') AS count FROM (SELECT unnest(['False', 'True']) AS category)"))
def _filled_categories(spark, sf_dir):
    return sa.filled_categories(sa.chosen(star.scores(spark, sf_dir), "error").where("event_id % 11 = 0 and string_value = 'True'"), "BOOLEAN")


@query("score_filled_bins", oracle("SELECT bin::BIGINT AS bin, (SELECT count(*) FROM scores, (SELECT min(value) AS l, max(value) AS h FROM scores WHERE name = 'click') WHERE name = 'click' AND floor((value - l) / ((h - l + 0.0001::DOUBLE) / 40)) = bin) AS count FROM range(40) t(bin)"))
def _filled_bins(spark, sf_dir):
    return sa.filled_bins(sa.distribution(sa.chosen(star.scores(spark, sf_dir), "click"), bins=40), 40)


@query("score_mode", oracle("SELECT source, arg_min(string_value, (-n, string_value)) AS mode, max(n) AS count FROM (SELECT source, string_value, count(*) AS n FROM scores WHERE name = 'signup' GROUP BY 1, 2) GROUP BY 1"))
def _mode(spark, sf_dir):
    return sa.most_frequent(sa.chosen(star.scores(spark, sf_dir), "signup"), "source")


@query("score_root_histogram", oracle("""SELECT least(floor((value - l) / ((h - l) / b)), b - 1)::BIGINT AS bin, b AS bins, count(*) AS count FROM (SELECT value FROM scores WHERE name = 'view'),
  (SELECT min(value) AS l, max(value) AS h, ceil(sqrt(count(*)))::BIGINT AS b FROM scores WHERE name = 'view') GROUP BY 1, 2"""))
def _root_histogram(spark, sf_dir):
    return sa.root_histogram(sa.chosen(star.scores(spark, sf_dir), "view"))


@query("score_filled_series", oracle("""SELECT time_dimension, category, coalesce(count, 0)::BIGINT AS count FROM (SELECT * FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS time_dimension),
  (SELECT DISTINCT string_value AS category FROM scores WHERE name = 'signup')) LEFT JOIN (SELECT date_trunc('day', timestamp)::TIMESTAMP AS time_dimension, string_value AS category, count(*) AS count FROM scores WHERE name = 'signup' GROUP BY 1, 2) USING (time_dimension, category)"""))
def _filled_series(spark, sf_dir):
    from spanlight.operators.timeseries import calendar

    series = sa.timeseries_categories(sa.chosen(star.scores(spark, sf_dir), "signup"), "day")
    return sa.filled_category_series(series, calendar(spark, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31), "day"))


@query("ingest_scores", """SELECT 's' || event_id AS id, 't' || user_id AS trace_id, event_type AS name, CASE event_type WHEN 'error' THEN 'BOOLEAN' WHEN 'signup' THEN 'CATEGORICAL' ELSE 'NUMERIC' END AS data_type,
  CASE event_type WHEN 'error' THEN (event_id % 2)::DOUBLE WHEN 'signup' THEN NULL ELSE event_id::DOUBLE / 4 END AS value, CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 1 THEN 'True' ELSE 'False' END WHEN 'signup' THEN 'kind ' || event_id % 5 END AS string_value,
  CASE WHEN event_id % 3 = 0 THEN 'note' END AS comment FROM events WHERE NOT (event_type = 'error' AND event_id % 7 = 0)""")
def _ingest_scores(spark, sf_dir):
    body = F.struct(
        F.expr("concat('s', event_id) AS id"), F.expr("concat('t', user_id) AS traceId"), F.col("event_type").alias("name"), F.expr("CASE WHEN event_type = 'error' THEN 'boolean' END AS dataType"),
        F.expr("CASE event_type WHEN 'error' THEN CASE WHEN event_id % 7 = 0 THEN '5' ELSE cast(event_id % 2 AS string) END WHEN 'signup' THEN concat('kind ', event_id % 5) ELSE cast(event_id / 4 AS string) END AS value"), F.expr("CASE WHEN event_id % 3 = 0 THEN 'note' END AS comment"))
    lines = star.table(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.lit("score-create").alias("type"), F.col("ts").cast("timestamp").alias("timestamp"), body.alias("body"))).alias("value"))
    return ingest.scores_of(ingest.parse_events(lines)[0]).select("id", "trace_id", "name", "data_type", "value", "string_value", "comment")


@query("ingest_defaults", oracle("SELECT span_id, CASE WHEN line = 3 THEN span_id ELSE trace_id END AS trace_id, CASE WHEN level = 'WARNING' THEN 'DEFAULT' ELSE level END AS level FROM child"))
def _defaults(spark, sf_dir):
    rows = star.child_spans(spark, sf_dir).selectExpr("span_id", "CASE WHEN span_id LIKE '%-3' THEN '' ELSE trace_id END AS trace_id", "CASE WHEN level = 'WARNING' THEN NULL ELSE level END AS level")
    return ingest.with_defaults(rows).select("span_id", "trace_id", "level")


@query("eval_schedule", oracle("SELECT span_id, start_time + INTERVAL 30 SECOND AS due_at FROM child WHERE type = 'GENERATION' AND ('0x' || left(sha256(span_id), 8))::BIGINT / 4294967295.0::DOUBLE < 0.3"))
def _schedule(spark, sf_dir):
    return ingest.scheduled(star.child_spans(spark, sf_dir), F.col("type") == "GENERATION", 0.3, 30).select("span_id", "due_at")


@query("otel_spans", oracle("""SELECT trace_id, span_id, parent_span_id, name, CASE WHEN line % 3 = 0 THEN 'GENERATION' WHEN line % 3 = 1 THEN 'TOOL' ELSE 'AGENT' END AS type, level, CASE WHEN line % 3 = 0 THEN provided_model_name END AS model, u_input AS input_tokens,
  '["t1",' || line || ',{"deep":' || CASE WHEN line % 2 = 0 THEN 'true' ELSE 'false' END || '}]' AS tools, 'lib' AS scope, 1 AS n_events FROM child WHERE level <> 'WARNING' AND u_input IS NOT NULL"""))
def _otel(spark, sf_dir):
    text = lambda key, value: f"""'{{"key":"{key}","value":{{"stringValue":"', {value}, '"}}}}'"""
    rows = star.child_spans(spark, sf_dir).where("level <> 'WARNING' and usage_details is not null").withColumn("line", F.expr("cast(split(span_id, '-')[1] AS int)"))
    kind = "CASE line % 3 WHEN 0 THEN 'LLM' WHEN 1 THEN 'TOOL' ELSE 'AGENT' END"
    attributes = f"""concat('[', {text('openinference.span.kind', kind)}, ',', CASE WHEN line % 3 = 0 THEN concat({text('gen_ai.request.model', 'provided_model_name')}, ',') ELSE '' END,
      '{{"key":"gen_ai.usage.input_tokens","value":{{"intValue":"', usage_details['input'], '"}}}},',
      '{{"key":"tools","value":{{"arrayValue":{{"values":[{{"stringValue":"t1"}},{{"intValue":"', line, '"}},{{"kvlistValue":{{"values":[{{"key":"deep","value":{{"boolValue":', CASE WHEN line % 2 = 0 THEN 'true' ELSE 'false' END, '}}}}]}}}}]}}}}}}]')"""
    line = f"""concat('{{"resourceSpans":[{{"resource":{{"attributes":[]}},"scopeSpans":[{{"scope":{{"name":"lib"}},"spans":[{{"traceId":"', trace_id, '","spanId":"', span_id, '","parentSpanId":"', parent_span_id, '","name":"', name,
      '","startTimeUnixNano":"1700000000000000000","endTimeUnixNano":"1700000001000000000","status":{{"code":', CASE WHEN level = 'ERROR' THEN 2 ELSE 1 END, '}},"events":[{{"name":"e","timeUnixNano":"1700000000500000000"}}],"attributes":', {attributes}, '}}]}}]}}]}}') AS value"""
    out = otel.read_spans(rows.selectExpr(line))
    return out.select("trace_id", "span_id", "parent_span_id", "name", "type", "level", F.col("provided_model_name").alias("model"), F.col("usage_details")["input"].alias("input_tokens"), F.col("metadata")["tools"].alias("tools"), "scope", F.size("events").alias("n_events"))
