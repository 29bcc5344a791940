"""Metrics, filters and time series as named queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from spanlight.operators import filters, timeseries
from spanlight.sources import star
from spanlight.sources.star import oracle

from . import metrics
from .registry import query, r4

ALL_TIME = ("1990-01-01", "2030-01-01")
LAT = "date_sub('millisecond', start_time, end_time)"
SEC = "nullif(date_sub('second', start_time, end_time), 0)"
INPUT, OUTPUT = "(u_input + u_cache)", "u_output"


def frames(spark, sf_dir):
    return {"spans": star.spans(spark, sf_dir), "scores": star.scores(spark, sf_dir)}


def total(x: str) -> str:
    return r4(f"coalesce(sum({x}), 0)")


def metric(name: str, sql: str, **spec):
    """Register a metrics query over all time, unless it says another."""
    spec = {"fromTimestamp": ALL_TIME[0], "toTimestamp": ALL_TIME[1], **spec}
    query(name, sql)(lambda spark, sf_dir: metrics.compile_query(spec, frames(spark, sf_dir)))


def m(measure: str, aggregation: str) -> dict:
    return {"measure": measure, "aggregation": aggregation}


def d(*names: str) -> list[dict]:
    return [{"field": n} for n in names]


metric(
    "metrics_obs_cost_by_model_daily",
    oracle(f"""SELECT provided_model_name AS "providedModelName", date_trunc('day', start_time)::TIMESTAMP AS time_dimension, {total('total_cost')} AS "sum_totalCost",
    {r4(f'quantile_cont({LAT}, 0.95)')} AS p95_latency FROM spans GROUP BY 1, 2"""),
    view="observations", dimensions=d("providedModelName"), metrics=[m("totalCost", "sum"), m("latency", "p95")], timeDimension={"granularity": "day"}, orderBy=[{"field": "time_dimension", "direction": "asc"}])

metric(
    "metrics_obs_all_measures",
    oracle(f"""SELECT type, count(*) AS sum_count, {r4(f'avg({LAT})')} AS avg_latency, {r4("avg(date_sub('millisecond', completion_start_time, end_time))")} AS "avg_streamingLatency",
    coalesce(sum({INPUT}), 0)::BIGINT AS "sum_inputTokens", coalesce(sum({OUTPUT}), 0)::BIGINT AS "sum_outputTokens", coalesce(sum(u_total), 0)::BIGINT AS "sum_totalTokens",
    {r4(f'avg({OUTPUT}::DOUBLE / {SEC})')} AS "avg_outputTokensPerSecond", {r4(f'avg(u_total::DOUBLE / {SEC})')} AS "avg_tokensPerSecond", {total('c_input')} AS "sum_inputCost", {total('c_output')} AS "sum_outputCost",
    {r4("avg(date_sub('millisecond', start_time, completion_start_time))")} AS "avg_timeToFirstToken", coalesce(sum(len(tools)), 0)::BIGINT AS "sum_toolDefinitions", coalesce(max(len(tools)), 0)::BIGINT AS "max_toolCalls" FROM spans GROUP BY 1""").replace(
        'coalesce(sum((u_input + u_cache)), 0)::BIGINT', 'coalesce(sum((u_input + u_cache)), 0)::DOUBLE').replace('coalesce(sum(u_output), 0)::BIGINT', 'coalesce(sum(u_output), 0)::DOUBLE'),
    view="observations", dimensions=d("type"), metrics=[
        m("count", "sum"), m("latency", "avg"), m("streamingLatency", "avg"), m("inputTokens", "sum"), m("outputTokens", "sum"), m("totalTokens", "sum"), m("outputTokensPerSecond", "avg"), m("tokensPerSecond", "avg"),
        m("inputCost", "sum"), m("outputCost", "sum"), m("timeToFirstToken", "avg"), m("toolDefinitions", "sum"), m("toolCalls", "max")])

metric(
    "metrics_obs_by_prompt_and_level",
    oracle(f"""SELECT prompt_name AS "promptName", prompt_version AS "promptVersion", level, environment, version, count(*) AS count_count, {total('total_cost')} AS "sum_totalCost"
    FROM spans WHERE type IN ('GENERATION') GROUP BY ALL"""),
    view="observations", dimensions=d("promptName", "promptVersion", "level", "environment", "version"), metrics=[m("count", "count"), m("totalCost", "sum")],
    filters=[{"type": "stringOptions", "column": "type", "operator": "any of", "value": ["GENERATION"]}])

metric(
    "metrics_obs_by_month",
    oracle("""SELECT strftime(start_time, '%Y-%m') AS "startTimeMonth", release AS "traceRelease", count(*) AS sum_count, count(DISTINCT u_total) AS "uniq_totalTokens" FROM spans GROUP BY 1, 2"""),
    view="observations", dimensions=d("startTimeMonth", "traceRelease"), metrics=[m("count", "sum"), m("totalTokens", "uniq")])

metric(
    "metrics_obs_by_trace_relation",
    oracle(f"""SELECT r.name AS "traceName", r.version AS "traceVersion", count(*) AS sum_count, {total('s.total_cost')} AS "sum_totalCost" FROM spans s JOIN root r USING (project_id, trace_id) GROUP BY 1, 2"""),
    view="observations", dimensions=d("traceName", "traceVersion"), metrics=[m("count", "sum"), m("totalCost", "sum")])

metric(
    "metrics_obs_by_score_relation",
    oracle(f"""SELECT n AS "scoreName", count(*) AS sum_count, sum(k)::BIGINT AS "sum_countScores" FROM spans
    JOIN (SELECT observation_id, min(name) AS n, count(*) AS k FROM scores GROUP BY 1) x ON span_id = observation_id GROUP BY 1"""),
    view="observations", dimensions=d("scoreName"), metrics=[m("count", "sum"), m("countScores", "sum")])

_TRACE_STATS = """st AS (SELECT project_id, trace_id, min(name) AS observation_name, count(span_id) AS n, date_sub('millisecond', min(start_time), max(end_time)) AS lat, sum(u_total) AS tok, sum(total_cost) AS cost FROM spans GROUP BY 1, 2)"""
metric(
    "metrics_traces_observations",
    oracle(f"""SELECT name, observation_name AS "observationName", count(*) AS sum_count, sum(n)::BIGINT AS "sum_observationsCount", {r4('avg(lat)')} AS avg_latency, {r4('quantile_cont(lat, 0.5)')} AS p50_latency,
    coalesce(sum(tok), 0)::BIGINT AS "sum_totalTokens", {total('cost')} AS "sum_totalCost" FROM root JOIN st USING (project_id, trace_id) GROUP BY 1, 2""", _TRACE_STATS),
    view="traces", dimensions=d("name", "observationName"), metrics=[m("count", "sum"), m("observationsCount", "sum"), m("latency", "avg"), m("latency", "p50"), m("totalTokens", "sum"), m("totalCost", "sum")])

metric(
    "metrics_traces_scores",
    oracle("""SELECT s AS "scoreName", count(*) AS count_count, sum(k)::BIGINT AS "sum_scoresCount" FROM root JOIN (SELECT trace_id, min(name) AS s, count(id) AS k FROM scores GROUP BY 1) x USING (trace_id) GROUP BY 1"""),
    view="traces", dimensions=d("scoreName"), metrics=[m("count", "count"), m("scoresCount", "sum")])

metric(
    "metrics_traces_both_relations",
    oracle(f"""SELECT name, sum(n)::BIGINT AS "sum_observationsCount", sum(k)::BIGINT AS "sum_scoresCount" FROM root JOIN st USING (project_id, trace_id) JOIN (SELECT trace_id, count(*) AS k FROM scores GROUP BY 1) x USING (trace_id) GROUP BY 1""", _TRACE_STATS),
    view="traces", dimensions=d("name"), metrics=[m("observationsCount", "sum"), m("scoresCount", "sum")])

metric(
    "metrics_traces_unique_users",
    oracle("""SELECT environment, strftime(start_time, '%Y-%m') AS "timestampMonth", count(DISTINCT nullif(user_id, '')) AS "uniq_uniqueUserIds", count(DISTINCT nullif(session_id, '')) AS "uniq_uniqueSessionIds" FROM root GROUP BY 1, 2"""),
    view="traces", dimensions=d("environment", "timestampMonth"), metrics=[m("uniqueUserIds", "uniq"), m("uniqueSessionIds", "uniq")])

metric(
    "metrics_traces_by_tags",
    oracle("""SELECT array_to_string(tags, ',') AS tags, count(*) AS sum_count FROM root WHERE list_has_any(tags, ['1-URGENT', 'O']) GROUP BY 1""").replace("array_to_string(tags, ',') AS tags", "tags"),
    view="traces", dimensions=d("tags"), metrics=[m("count", "sum")], filters=[{"type": "arrayOptions", "column": "tags", "operator": "any of", "value": ["1-URGENT", "O"]}])

metric(
    "metrics_scores_numeric_by_source",
    oracle(f"""SELECT name, source, data_type AS "dataType", count(*) AS sum_count, {r4('avg(value)')} AS avg_value, {r4('quantile_cont(value, 0.9)')} AS p90_value FROM scores WHERE data_type NOT LIKE '%CATEGORICAL%' GROUP BY 1, 2, 3"""),
    view="scores-numeric", dimensions=d("name", "source", "dataType"), metrics=[m("count", "sum"), m("value", "avg"), m("value", "p90")])

metric(
    "metrics_scores_numeric_by_trace",
    oracle(f"""SELECT r.name AS "traceName", r.release AS "traceRelease", count(*) AS count_count, {r4('avg(value)')} AS avg_value FROM scores s JOIN root r USING (trace_id) WHERE data_type <> 'CATEGORICAL' GROUP BY 1, 2"""),
    view="scores-numeric", dimensions=d("traceName", "traceRelease"), metrics=[m("count", "count"), m("value", "avg")])

metric(
    "metrics_scores_numeric_by_model",
    oracle(f"""SELECT p.provided_model_name AS "observationModelName", p.name AS "observationName", count(*) AS count_count, {r4('max(value)')} AS max_value FROM scores s JOIN spans p ON s.observation_id = p.span_id WHERE data_type <> 'CATEGORICAL' GROUP BY 1, 2"""),
    view="scores-numeric", dimensions=d("observationModelName", "observationName"), metrics=[m("count", "count"), m("value", "max")])

metric(
    "metrics_scores_categorical_by_value",
    oracle("""SELECT string_value AS "stringValue", date_trunc('day', timestamp)::TIMESTAMP AS time_dimension, count(*) AS sum_count FROM scores WHERE data_type = 'CATEGORICAL' GROUP BY 1, 2"""),
    view="scores-categorical", dimensions=d("stringValue"), metrics=[m("count", "sum")], timeDimension={"granularity": "day"}, fillGaps=False)

for _name, _sql in {
    "sum": total(LAT), "avg": r4(f"avg({LAT})"), "count": f"count({LAT})", "min": f"min({LAT})", "max": f"max({LAT})", "uniq": f"count(DISTINCT {LAT})",
    **{p: r4(f"quantile_cont({LAT}, {q})") for p, q in metrics.PERCENTILES.items()},
}.items():
    _sql = f"coalesce(sum({LAT}), 0)::BIGINT" if _name == "sum" else _sql
    metric(f"agg_{_name}", oracle(f"SELECT level, {_sql} AS {_name}_latency FROM spans GROUP BY 1"), view="observations", dimensions=d("level"), metrics=[m("latency", _name)])

_HISTOGRAM = """bounds AS (SELECT type, min(x) AS lo, max(x) AS hi FROM (SELECT type, date_sub('millisecond', start_time, end_time)::DOUBLE AS x FROM spans) GROUP BY 1),
placed AS (SELECT type, lo, hi, CASE WHEN hi = lo THEN 0 ELSE least(floor((date_sub('millisecond', start_time, end_time) - lo) / ((hi - lo) / 8)), 7) END::BIGINT AS bin FROM spans JOIN bounds USING (type))"""
metric(
    "agg_histogram",
    oracle(f"SELECT type, bin, {r4('min(lo) + bin * ((min(hi) - min(lo)) / 8)')} AS lower, {r4('min(lo) + (bin + 1) * ((min(hi) - min(lo)) / 8)')} AS upper, count(*) AS count FROM placed GROUP BY type, bin", _HISTOGRAM),
    view="observations", dimensions=d("type"), metrics=[m("latency", "histogram")], bins=8)

_PAIRS = "pairs AS (SELECT environment, k, v FROM (SELECT environment, unnest(['input', 'output', 'total']) AS k, unnest([c_input, c_output, total_cost]) AS v FROM child))"
metric(
    "pairexpand_cost_by_type", oracle(f"""SELECT environment, k AS "costType", {total('v')} AS "sum_costByType" FROM pairs GROUP BY 1, 2""", _PAIRS),
    view="observations", dimensions=d("environment"), metrics=[m("costByType", "sum")])
metric(
    "pairexpand_usage_by_type",
    oracle("""SELECT k AS "usageType", coalesce(sum(v), 0)::BIGINT AS "sum_usageByType", max(v) AS "max_usageByType" FROM (SELECT unnest(['input', 'cache_read_input', 'output', 'total']) AS k, unnest([u_input, u_cache, u_output, u_total]) AS v FROM child WHERE line <> 5) GROUP BY 1"""),
    view="observations", dimensions=d("usageType"), metrics=[m("usageByType", "sum"), m("usageByType", "max")])
for _name, _field in (("explode_tool_names", "toolNames"), ("explode_called_tool_names", "calledToolNames")):
    metric(_name, oracle(f"""SELECT t AS "{_field}", count(*) AS sum_count FROM (SELECT unnest(tools) AS t FROM child) GROUP BY 1"""), view="observations", dimensions=d(_field), metrics=[m("count", "sum")])

metric(
    "metrics_top_users",
    oracle(f"""SELECT nullif(user_id, '') AS "userId", {total('total_cost')} AS "sum_totalCost" FROM spans GROUP BY 1 ORDER BY coalesce(sum(total_cost), 0) DESC, 1 NULLS FIRST LIMIT 25"""),
    view="observations", dimensions=d("userId"), metrics=[m("totalCost", "sum")], orderBy=[{"field": "sum_totalCost", "direction": "desc"}], rowLimit=25)


# filters: each as a count and the ends of the ids it lets pass
def _filter(name: str, where: str, *found: dict, child: bool = True) -> None:
    sql = oracle(f"SELECT count(*) AS n, min(span_id) AS first_id, max(span_id) AS last_id FROM {'child' if child else 'spans'} WHERE {where}")

    def run(spark, sf_dir):
        rows = (star.child_spans if child else star.spans)(spark, sf_dir)
        columns = {c: c for c in rows.columns} | {"usage": F.expr("transform(map_entries(usage_details), e -> named_struct('name', e.key, 'value', e.value))"), "labels": F.expr("array(concat('level:', level), concat('env:', environment))"), "isRoot": F.col("parent_span_id") == ""}
        return rows.where(filters.all_of(found, columns)).agg(F.count(F.lit(1)).alias("n"), F.min("span_id").alias("first_id"), F.max("span_id").alias("last_id"))

    query(name, sql)(run)


def _f(kind: str, column: str, operator: str, value=None, key: str | None = None) -> dict:
    return {"type": kind, "column": column, "operator": operator, "value": value} | ({"key": key} if key else {})


_filter("filter_string_eq", "name = 'step-3'", _f("string", "name", "=", "step-3"))
_filter("filter_string_contains", "contains(provided_model_name, 'el-A')", _f("string", "provided_model_name", "contains", "el-A"))
_filter("filter_string_not_contains", "instr(prompt_name, '-1') = 0", _f("string", "prompt_name", "does not contain", "-1"))
_filter("filter_string_starts", "starts_with(user_id, 'u12')", _f("string", "user_id", "starts with", "u12"))
_filter("filter_string_ends", "ends_with(span_id, '-4')", _f("string", "span_id", "ends with", "-4"))
for _op, _key in (("=", "eq"), (">", "gt"), ("<", "lt"), (">=", "ge"), ("<=", "le"), ("!=", "ne")):
    _filter(f"filter_number_{_key}", f"total_cost {_op} 12.5", _f("number", "total_cost", _op, 12.5))
for _op, _key in ((">", "gt"), ("<", "lt"), (">=", "ge"), ("<=", "le")):
    _filter(f"filter_datetime_{_key}", f"start_time {_op} TIMESTAMP '1998-05-01 00:00:02'", _f("datetime", "start_time", _op, "1998-05-01T00:00:02Z"))
_filter("filter_options_any", "level IN ('ERROR', 'WARNING')", _f("stringOptions", "level", "any of", ["ERROR", "WARNING"]))
_filter("filter_options_none", "level NOT IN ('ERROR', 'WARNING')", _f("stringOptions", "level", "none of", ["ERROR", "WARNING"]))
_filter("filter_options_empty", "false", _f("stringOptions", "level", "any of", []))
_filter("filter_boolean", "parent_span_id = ''", _f("boolean", "isRoot", "=", True), child=False)
_filter("filter_null", "prompt_name IS NULL", _f("null", "prompt_name", "is null"))
_filter("filter_not_null", "session_id IS NOT NULL", _f("null", "session_id", "is not null"))
_filter("filter_array_any", "list_has_any(tags, ['1-URGENT', 'F'])", _f("arrayOptions", "tags", "any of", ["1-URGENT", "F"]))
_filter("filter_array_none", "NOT list_has_any(tags, ['1-URGENT', 'F'])", _f("arrayOptions", "tags", "none of", ["1-URGENT", "F"]))
_filter("filter_array_all", "list_has_all(tags, ['1-URGENT', 'F'])", _f("arrayOptions", "tags", "all of", ["1-URGENT", "F"]))
_filter("filter_category_any", "level = 'ERROR'", _f("categoryOptions", "labels", "any of", ["ERROR"], "level"))
_filter("filter_category_none", "environment <> 'P'", _f("categoryOptions", "labels", "none of", ["P"], "env"))
_filter("filter_string_object", "starts_with(part, '17')", _f("stringObject", "metadata", "starts with", "17", "part"))
_filter("filter_string_object_contains", "contains(supp, '7')", _f("stringObject", "metadata", "contains", "7", "supp"))
_filter("filter_number_object", "u_output > 90", _f("numberObject", "usage", ">", 90, "output"))
_filter("filter_conjunction", "level = 'DEFAULT' AND u_input <= 3 AND instr(name, '2') = 0", _f("string", "level", "=", "DEFAULT"), _f("numberObject", "usage", "<=", 3, "input"), _f("string", "name", "does not contain", "2"))

for _mode, _n, _where in (("root", 1, "parent_span_id = ''"), ("last", 1, "down = 1"), ("nthFromStart", 3, "up = 3"), ("nthFromEnd", 2, "down = 2")):
    query(f"position_{_mode}", oracle(
        f"SELECT span_id, trace_id FROM numbered WHERE {_where}",
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY project_id, trace_id ORDER BY start_time, span_id) AS up, row_number() OVER (PARTITION BY project_id, trace_id ORDER BY start_time DESC, span_id DESC) AS down FROM spans)"),
    )(lambda spark, sf_dir, mode=_mode, n=_n: filters.position_in_trace(star.spans(spark, sf_dir), mode, n).select("span_id", "trace_id"))

# time series over the events, whose 30 days leave gaps where the range or a type is narrow
for _size in timeseries.GRANULARITIES:
    metric(
        f"timeseries_{_size}", oracle(f"SELECT date_trunc('{_size}', timestamp)::TIMESTAMP AS time_dimension, name, count(*) AS sum_count, {r4('avg(value)')} AS avg_value FROM scores WHERE data_type <> 'CATEGORICAL' GROUP BY 1, 2"),
        view="scores-numeric", dimensions=d("name"), metrics=[m("count", "sum"), m("value", "avg")], timeDimension={"granularity": _size}, fillGaps=False)

_RANGE = (dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3, 12))
_HOURS = "hours AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-03 12:00:00', INTERVAL 10 MINUTE)) AS x), minutes AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-03 12:00:00', INTERVAL 1 MINUTE)) AS time_dimension)"
_IN = "timestamp BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-03 12:00:00'"
metric(
    "timeseries_gapfill",
    oracle(f"SELECT time_dimension, coalesce(c, 0)::BIGINT AS sum_count FROM minutes LEFT JOIN (SELECT date_trunc('minute', timestamp)::TIMESTAMP AS time_dimension, count(*) AS c FROM scores WHERE name = 'error' AND {_IN} GROUP BY 1) USING (time_dimension)", _HOURS),
    view="scores-numeric", metrics=[m("count", "sum")], filters=[_f("string", "name", "=", "error")], timeDimension={"granularity": "minute"}, fromTimestamp=_RANGE[0], toTimestamp=_RANGE[1])
metric(
    "timeseries_gapfill_dims",
    oracle(f"""SELECT time_dimension, name, sum_count FROM hit UNION ALL SELECT time_dimension, '' AS name, NULL::BIGINT AS sum_count FROM minutes WHERE time_dimension NOT IN (SELECT time_dimension FROM hit)""",
           _HOURS, f"hit AS (SELECT date_trunc('minute', timestamp)::TIMESTAMP AS time_dimension, name, count(*) AS sum_count FROM scores WHERE data_type <> 'CATEGORICAL' AND {_IN} GROUP BY 1, 2)"),
    view="scores-numeric", dimensions=d("name"), metrics=[m("count", "sum")], timeDimension={"granularity": "minute"}, fromTimestamp=_RANGE[0], toTimestamp=_RANGE[1])


def _counts(spark, sf_dir, size="hour"):
    return star.scores(spark, sf_dir).groupBy(timeseries.bucket("timestamp", size).alias("time_dimension"), "name").agg(F.count(F.lit(1)).alias("n"))


@query("timeseries_densify", oracle("""SELECT time_dimension, name, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT time_dimension FROM hit) CROSS JOIN (SELECT DISTINCT name FROM scores) LEFT JOIN hit USING (time_dimension, name)""",
       "hit AS (SELECT date_trunc('hour', timestamp)::TIMESTAMP AS time_dimension, name, count(*) AS n FROM scores GROUP BY 1, 2)"))
def _densify(spark, sf_dir):
    return timeseries.densify(_counts(spark, sf_dir), star.scores(spark, sf_dir).select("name").distinct(), "name", "n")


@query("timeseries_edges", oracle("""SELECT time_dimension, name, n FROM hit UNION ALL SELECT t, name, 0 FROM (SELECT DISTINCT name FROM hit), (VALUES (TIMESTAMP '2024-01-01'), (TIMESTAMP '2024-02-05')) AS e(t) WHERE (t, name) NOT IN (SELECT (time_dimension, name) FROM hit)""",
       "hit AS (SELECT date_trunc('day', timestamp)::TIMESTAMP AS time_dimension, name, count(*) AS n FROM scores GROUP BY 1, 2)"))
def _edges(spark, sf_dir):
    return timeseries.with_edges(_counts(spark, sf_dir, "day"), dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 5), "name", "n")


@query("timeseries_up_to_last", oracle("""SELECT time_dimension, n FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-25', (SELECT max(time_dimension) FROM hit), INTERVAL 1 HOUR)) AS time_dimension) LEFT JOIN hit USING (time_dimension)""",
       "hit AS (SELECT date_trunc('hour', timestamp)::TIMESTAMP AS time_dimension, count(*) AS n FROM scores WHERE name = 'signup' GROUP BY 1)"))
def _up_to_last(spark, sf_dir):
    hits = _counts(spark, sf_dir).where("name = 'signup'").drop("name")
    return timeseries.up_to_last(hits, dt.datetime(2023, 12, 25), "hour", ["n"])


@query("timeseries_rebucket", oracle("""SELECT TIMESTAMP '2024-02-01' - to_seconds((floor(date_sub('second', time_dimension, TIMESTAMP '2024-02-01') / 21600) + 1)::BIGINT * 21600) AS time_dimension, sum(n)::BIGINT AS n FROM hit GROUP BY 1""",
       "hit AS (SELECT date_trunc('hour', timestamp)::TIMESTAMP AS time_dimension, count(*) AS n FROM scores GROUP BY 1)"))
def _rebucket(spark, sf_dir):
    return timeseries.rebucket(_counts(spark, sf_dir).groupBy("time_dimension").agg(F.sum("n").alias("n")), 21600, dt.datetime(2024, 2, 1), ["n"])


@query("timeseries_floor_buckets", oracle("SELECT time_bucket(INTERVAL 10 MINUTE, timestamp, TIMESTAMP '1970-01-01') AS time_dimension, count(*) AS n FROM scores GROUP BY 1"))
def _floor(spark, sf_dir):
    return star.scores(spark, sf_dir).groupBy(timeseries.floored("timestamp", 600).alias("time_dimension")).agg(F.count(F.lit(1)).alias("n"))
