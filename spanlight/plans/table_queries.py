"""List tables, facets, pages, reports, dataset runs, score analytics, search and trees as named queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from spanlight.functions import scalars
from spanlight.operators import datasets, rollups, search, tables, tree
from spanlight.operators import score_analytics as sa
from spanlight.sources import reader, sinks, star
from spanlight.sources.star import oracle

from .registry import query, r4


_STATS = f"""stats AS (SELECT project_id, trace_id, count(*) AS n_observations, count(*) FILTER (level = 'DEBUG') AS n_debug, count(*) FILTER (level = 'DEFAULT') AS n_default, count(*) FILTER (level = 'WARNING') AS n_warning,
  count(*) FILTER (level = 'ERROR') AS n_error, CASE max(CASE level WHEN 'ERROR' THEN 4 WHEN 'WARNING' THEN 3 WHEN 'DEFAULT' THEN 2 ELSE 1 END) WHEN 4 THEN 'ERROR' WHEN 3 THEN 'WARNING' WHEN 2 THEN 'DEFAULT' ELSE 'DEBUG' END AS level,
  date_sub('millisecond', min(start_time), CASE WHEN max(start_time) > max(end_time) THEN max(start_time) ELSE max(end_time) END) AS latency_ms, sum(u_input + u_cache)::BIGINT AS input_tokens, sum(u_output)::BIGINT AS output_tokens,
  sum(u_total)::BIGINT AS total_tokens, sum(total_cost) AS total_cost FROM child GROUP BY 1, 2)"""


@query("table_traces", oracle(f"""SELECT project_id, trace_id, span_id, start_time, name, user_id, session_id, environment, release, version, n_observations, n_debug, n_default, n_warning, n_error, stats.level, latency_ms, input_tokens, output_tokens,
  total_tokens, {r4('stats.total_cost')} AS total_cost FROM root LEFT JOIN stats USING (project_id, trace_id)""", _STATS))
def _traces(spark, sf_dir):
    return tables.traces_table(star.spans(spark, sf_dir)).drop("tags", "event_ts")


@query("table_traces_scores", oracle("""SELECT trace_id, name, a AS scores_avg, c AS categories FROM root LEFT JOIN (
  SELECT trace_id, string_agg(n || '=' || v, ',' ORDER BY n) FILTER (t <> 'CATEGORICAL') AS a, string_agg(n || ':' || s, ',' ORDER BY n, s) FILTER (t = 'CATEGORICAL') AS c
  FROM (SELECT trace_id, name AS n, data_type AS t, string_value AS s, floor(avg(value))::BIGINT AS v FROM scores WHERE data_type <> 'BOOLEAN' GROUP BY 1, 2, 3, 4) GROUP BY 1) USING (trace_id)"""))
def _traces_scores(spark, sf_dir):
    scores = star.scores(spark, sf_dir).where("data_type <> 'BOOLEAN'")
    out = tables.traces_table(star.spans(spark, sf_dir), scores, with_stats=False)
    return out.select("trace_id", "name", F.expr("nullif(array_join(transform(scores_avg, x -> concat(x.name, '=', floor(x.avg))), ','), '') AS scores_avg"), F.expr("nullif(array_join(categories, ','), '') AS categories"))


@query("table_sessions", oracle(f"""SELECT project_id, session_id, min(start_time) AS first_at, max(start_time) AS last_at, count(DISTINCT trace_id) AS n_traces, count(DISTINCT nullif(user_id, '')) AS n_users, min(environment) AS environment,
  sum(n_observations)::BIGINT AS n_observations, sum(total_tokens)::BIGINT AS total_tokens, {r4('sum(stats.total_cost)')} AS total_cost, date_sub('second', min(start_time), max(start_time)) AS duration_s,
  (SELECT count(DISTINCT x) FROM (SELECT unnest(tags) AS x FROM root q WHERE q.project_id = r.project_id AND q.session_id = r.session_id)) AS n_tags, coalesce(any_value(k), 0)::BIGINT AS n_scores
  FROM root r LEFT JOIN stats USING (project_id, trace_id) LEFT JOIN (SELECT session_id, count(*) AS k FROM scores GROUP BY 1) z USING (session_id) WHERE coalesce(session_id, '') <> '' GROUP BY 1, 2""", _STATS))
def _sessions(spark, sf_dir):
    out = tables.sessions_table(star.spans(spark, sf_dir), star.scores(spark, sf_dir))
    return out.withColumn("n_users", F.size("user_ids")).withColumn("n_tags", F.size("tags")).drop("user_ids", "tags")


@query("table_users", oracle(f"""SELECT project_id, user_id, count(DISTINCT trace_id) AS n_traces, count(*) AS n_spans, min(start_time) AS first_at, max(start_time) AS last_at, sum(u_input + u_cache)::BIGINT AS input_tokens,
  sum(u_output)::BIGINT AS output_tokens, sum(u_total)::BIGINT AS total_tokens, {r4('sum(total_cost)')} AS total_cost FROM spans WHERE coalesce(user_id, '') <> '' GROUP BY 1, 2"""))
def _users(spark, sf_dir):
    return tables.users_table(star.spans(spark, sf_dir))


@query("table_users_by_roots", oracle(f"""SELECT project_id, r.user_id, count(DISTINCT trace_id) AS n_traces, count(*) FILTER (s.parent_span_id <> '') AS n_observations, {r4('sum(s.total_cost)')} AS total_cost
  FROM spans s JOIN root r USING (project_id, trace_id) WHERE coalesce(r.user_id, '') <> '' GROUP BY 1, 2"""))
def _users_by_roots(spark, sf_dir):
    return tables.users_by_roots(star.spans(spark, sf_dir))


@query("table_observations", oracle(f"""SELECT c.project_id, c.trace_id, c.span_id, c.type, c.name, c.level, coalesce(nullif(c.environment, ''), r.environment) AS environment, coalesce(nullif(c.user_id, ''), r.user_id) AS user_id, r.name AS trace_name, c.start_time,
  date_sub('millisecond', c.start_time, c.end_time) AS latency_ms, date_sub('millisecond', c.start_time, c.completion_start_time) AS ttft_ms, c.provided_model_name, c.u_total AS total_tokens, {r4('c.total_cost')} AS total_cost,
  len(c.tools) AS n_tool_definitions, len(c.tools) AS n_tool_calls, true AS has_metadata FROM child c LEFT JOIN root r USING (project_id, trace_id)"""))
def _observations(spark, sf_dir):
    return tables.observations_table(star.spans(spark, sf_dir))


@query("table_scores", oracle(f"""SELECT id, trace_id, s.name, source, data_type, {r4('value')} AS value, string_value, timestamp, r.name AS trace_name, user_id, list_sort(tags) AS tags, metadata <> '' AS has_metadata FROM scores s LEFT JOIN root r USING (trace_id)""").replace(
    "user_id, list_sort", "r.user_id, list_sort").replace(", tags) AS tags", ", r.tags) AS tags"))
def _scores(spark, sf_dir):
    return tables.scores_table(star.scores(spark, sf_dir), star.spans(spark, sf_dir))


_FACETS = {
    "name": ("spans", "name"), "model": ("spans", "provided_model_name"), "prompt": ("spans", "prompt_name"), "user": ("spans", "user_id"), "session": ("spans", "session_id"), "level": ("spans", "level"), "type": ("spans", "type"),
    "release": ("spans", "release"), "version": ("spans", "version"), "environment": ("spans", "environment"), "score_name": ("scores", "name"), "score_source": ("scores", "source"), "score_string_value": ("scores", "string_value"),
}
for _name, (_frame, _column) in _FACETS.items():
    query(f"facet_{_name}", oracle(f"SELECT {_column} AS value, count(*) AS count FROM {_frame} WHERE {_column} IS NOT NULL AND {_column} <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1000"))(
        lambda spark, sf_dir, frame=_frame, column=_column: tables.facet(getattr(star, frame)(spark, sf_dir), column))


@query("facet_is_root", oracle("SELECT parent_span_id = '' AS value, count(*) AS count FROM spans GROUP BY 1"))
def _facet_root(spark, sf_dir):
    return tables.facet(star.spans(spark, sf_dir), F.col("parent_span_id") == "")


@query("facet_tags", oracle("SELECT value, count(*) AS count FROM (SELECT unnest(tags) AS value FROM root) GROUP BY 1"))
def _facet_tags(spark, sf_dir):
    return tables.array_facet(tables.roots(star.spans(spark, sf_dir)), "tags")


@query("facet_tools", oracle("SELECT value, count(*) AS count FROM (SELECT unnest(tools) AS value FROM child) GROUP BY 1"))
def _facet_tools(spark, sf_dir):
    return tables.array_facet(star.spans(spark, sf_dir), F.map_keys("tool_definitions"))


@query("facet_categories", oracle("SELECT name, list_sort(list(DISTINCT string_value)) AS \"values\" FROM scores WHERE data_type = 'CATEGORICAL' GROUP BY 1"))
def _facet_categories(spark, sf_dir):
    return tables.category_facet(star.scores(spark, sf_dir))


@query("environments", oracle("SELECT environment FROM spans WHERE environment IS NOT NULL UNION SELECT environment FROM scores UNION SELECT 'default'"))
def _environments(spark, sf_dir):
    return tables.environments(star.spans(spark, sf_dir), star.scores(spark, sf_dir))


@query("page_offset", oracle("SELECT trace_id, span_id, start_time FROM spans ORDER BY start_time DESC, trace_id DESC, span_id DESC LIMIT 50 OFFSET 150"))
def _page_offset(spark, sf_dir):
    rows = star.spans(spark, sf_dir).select("trace_id", "span_id", "start_time")
    return tables.offset_page(rows, [F.col(c).desc() for c in ("start_time", "trace_id", "span_id")], 3, 50)


@query("page_keyset", oracle("SELECT trace_id, span_id, start_time FROM spans WHERE (start_time, trace_id, span_id) < (TIMESTAMP '1999-06-01 00:00:03', '5', '5-1') ORDER BY start_time DESC, trace_id DESC, span_id DESC LIMIT 51"))
def _page_keyset(spark, sf_dir):
    rows = star.spans(spark, sf_dir).select("trace_id", "span_id", "start_time")
    return tables.keyset_page(rows, ("start_time", "trace_id", "span_id"), (dt.datetime(1999, 6, 1, 0, 0, 3), "5", "5-1"), 50)


@query("surrounding_rows", oracle("SELECT id, timestamp FROM (SELECT * FROM scores WHERE timestamp < TIMESTAMP '2024-01-15 12:00:00' ORDER BY timestamp DESC, id DESC LIMIT 20) UNION ALL SELECT id, timestamp FROM (SELECT * FROM scores WHERE timestamp >= TIMESTAMP '2024-01-15 12:00:00' ORDER BY timestamp, id LIMIT 20)"))
def _surrounding(spark, sf_dir):
    return tables.surrounding(star.scores(spark, sf_dir), "timestamp", dt.datetime(2024, 1, 15, 12), 20, "id").select("id", "timestamp")


@query("capped_trace", oracle("SELECT span_id, start_time FROM spans WHERE trace_id = '77' ORDER BY start_time, span_id LIMIT 4"))
def _capped(spark, sf_dir):
    return tables.capped(star.spans(spark, sf_dir), "77", 3).select("span_id", "start_time")


@query("exists_trace", oracle("SELECT count(*) > 0 AS found FROM spans WHERE trace_id = '3' AND level = 'DEFAULT'"))
def _exists(spark, sf_dir):
    return tables.exists(star.spans(spark, sf_dir).where("trace_id = '3' AND level = 'DEFAULT'"))


@query("latest_root_per_trace", oracle("SELECT project_id, trace_id, span_id, event_ts FROM root"))
def _latest_root(spark, sf_dir):
    return tables.latest_root(star.spans(spark, sf_dir)).select("project_id", "trace_id", "span_id", "event_ts")


@query("trace_scalars_latest", oracle("""SELECT project_id, trace_id, arg_max(nullif(user_id, ''), (event_ts, span_id)) AS user_id, arg_max(nullif(session_id, ''), (event_ts, span_id)) AS session_id, arg_max(environment, (event_ts, span_id)) AS environment,
  arg_max(release, (event_ts, span_id)) AS release, arg_max(version, (event_ts, span_id)) AS version, arg_max(trace_name, (event_ts, span_id)) AS trace_name, min(start_time) AS first_start, count(*) AS n_spans FROM spans GROUP BY 1, 2"""))
def _scalars(spark, sf_dir):
    return tables.trace_scalars(star.spans(spark, sf_dir))


@query("map_sum_merge", oracle("""SELECT project_id, trace_id, 'cache_read_input=' || sum(u_cache)::BIGINT || ',input=' || sum(u_input)::BIGINT || ',output=' || sum(u_output)::BIGINT || ',total=' || sum(u_total)::BIGINT AS usage FROM child WHERE u_total IS NOT NULL GROUP BY 1, 2"""))
def _map_sums(spark, sf_dir):
    return tables.map_sums(star.spans(spark, sf_dir), "usage_details").select("project_id", "trace_id", F.expr("array_join(transform(map_entries(usage_details), e -> concat(e.key, '=', e.value)), ',') AS usage"))


@query("daily_metrics", oracle(f"SELECT project_id, start_time::DATE::VARCHAR AS day, count(DISTINCT trace_id) FILTER (parent_span_id = '') AS n_traces, count(*) FILTER (parent_span_id <> '') AS n_observations, {r4('coalesce(sum(total_cost), 0)')} AS total_cost FROM spans GROUP BY 1, 2"))
def _daily(spark, sf_dir):
    return rollups.daily_metrics(star.spans(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query("daily_usage", oracle(f"""SELECT start_time::DATE::VARCHAR AS day, provided_model_name AS model, count(*) AS n_observations, count(DISTINCT trace_id) AS n_traces, sum(u_input + u_cache)::BIGINT AS input_usage, sum(u_output)::BIGINT AS output_usage,
  {r4('sum(total_cost)')} AS total_cost FROM child GROUP BY 1, 2"""))
def _daily_usage(spark, sf_dir):
    return rollups.daily_usage(star.spans(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query("prompt_metrics", oracle(f"""SELECT prompt_name, prompt_version, count(*) AS n, min(start_time) AS first_at, max(start_time) AS last_at, {r4("quantile_cont(date_sub('millisecond', start_time, end_time), 0.5)")} AS median_latency_ms,
  {r4('quantile_cont((u_input + u_cache)::DOUBLE, 0.5)')} AS median_input, {r4('quantile_cont(u_output::DOUBLE, 0.5)')} AS median_output, {r4('quantile_cont(total_cost::DOUBLE, 0.5)')} AS median_cost FROM child WHERE prompt_name IS NOT NULL GROUP BY 1, 2"""))
def _prompts(spark, sf_dir):
    return rollups.prompt_metrics(star.spans(spark, sf_dir))


@query("score_aggregate", oracle(f"SELECT name, source, data_type, count(*) AS count, {r4('avg(value)')} AS avg FROM scores GROUP BY 1, 2, 3"))
def _score_aggregate(spark, sf_dir):
    return rollups.score_aggregate(star.scores(spark, sf_dir))


@query("score_aggregate_merged", oracle(f"""SELECT name, source, data_type, CASE WHEN data_type = 'CATEGORICAL' THEN string_value END AS string_value, count(*) AS count, CASE WHEN data_type <> 'CATEGORICAL' THEN {r4('avg(value)')} END AS avg FROM scores GROUP BY 1, 2, 3, 4"""))
def _score_merged(spark, sf_dir):
    return rollups.score_aggregate_merged(star.scores(spark, sf_dir))


@query("cost_by_type_over_time", oracle(f"""SELECT date_trunc('month', start_time)::TIMESTAMP AS time_dimension, k AS key, {r4('sum(v)')} AS value FROM (SELECT start_time, unnest(['input', 'output', 'total']) AS k, unnest([c_input, c_output, total_cost]) AS v FROM child) GROUP BY 1, 2"""))
def _cost_over_time(spark, sf_dir):
    return rollups.usage_by_time(star.spans(spark, sf_dir), "cost_details", "month")


@query("trace_costs", oracle(f"SELECT project_id, trace_id, {r4('sum(total_cost)')} AS total_cost, date_sub('millisecond', min(start_time), max(end_time)) AS latency_ms FROM spans GROUP BY 1, 2"))
def _trace_costs(spark, sf_dir):
    return rollups.trace_costs(star.spans(spark, sf_dir))


@query("cost_by_metadata", oracle(f"SELECT supp AS \"group\", count(*) AS n, {r4('sum(total_cost)')} AS total_cost, {r4('sum(total_cost)::DOUBLE / count(total_cost)')} AS avg_cost FROM child WHERE supp IS NOT NULL GROUP BY 1"))
def _cost_by_metadata(spark, sf_dir):
    return rollups.cost_by_metadata(star.spans(spark, sf_dir), "supp")


@query("counts_by_project", oracle("""SELECT project_id, coalesce(n_traces, 0)::BIGINT AS n_traces, coalesce(n_observations, 0)::BIGINT AS n_observations, coalesce(n_scores, 0)::BIGINT AS n_scores
  FROM (SELECT project_id, count(*) FILTER (parent_span_id = '') AS n_traces, count(*) FILTER (parent_span_id <> '') AS n_observations FROM spans WHERE start_time >= TIMESTAMP '1996-01-01' AND start_time < TIMESTAMP '2025-01-01' GROUP BY 1)
  FULL JOIN (SELECT project_id, count(*) AS n_scores FROM scores JOIN root USING (trace_id) WHERE timestamp >= TIMESTAMP '1996-01-01' AND timestamp < TIMESTAMP '2025-01-01' GROUP BY 1) USING (project_id)"""))
def _counts_by_project(spark, sf_dir):
    return rollups.counts_by_project(star.spans(spark, sf_dir), star.scores(spark, sf_dir), dt.datetime(1996, 1, 1), dt.datetime(2025, 1, 1))


@query("field_sizes", f"SELECT {r4('avg(coalesce(length(text), 0))')} AS avg_text, {r4('avg(coalesce(length(source), 0))')} AS avg_source FROM documents")
def _field_sizes(spark, sf_dir):
    return rollups.field_sizes(star.table(spark, sf_dir, "documents"), "text", "source")


@query("json_path_counts", "SELECT json_extract_string(props, '$.k') AS value, count(*) AS count FROM events GROUP BY 1")
def _json(spark, sf_dir):
    return rollups.json_field_counts(star.table(spark, sf_dir, "events"), "props", "k")


@query("pivot_report", oracle(f"""SELECT 2 - grouping(environment) - grouping(level) AS depth, environment, level, {r4('sum(total_cost)')} AS sum, {r4('sum(total_cost)::DOUBLE / count(total_cost)')} AS avg, count(total_cost) AS count FROM child GROUP BY ROLLUP (environment, level)"""))
def _pivot(spark, sf_dir):
    return rollups.pivot_report(star.child_spans(spark, sf_dir), ["environment", "level"], "total_cost")


_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, dataset_id, run_id, item_id ORDER BY created_at DESC, seq DESC) AS rn FROM run_items) WHERE rn = 1)"
_TR = "tr AS (SELECT project_id, trace_id, sum(total_cost) AS cost, min(start_time) AS a, max(end_time) AS b FROM spans GROUP BY 1, 2)"


@query("dataset_latest_items", oracle("SELECT project_id, dataset_id, run_id, item_id, trace_id, created_at FROM latest", _LATEST))
def _latest_items(spark, sf_dir):
    return datasets.latest_items(star.run_items(spark, sf_dir)).select("project_id", "dataset_id", "run_id", "item_id", "trace_id", "created_at")


@query("dataset_runs", oracle(f"""SELECT project_id, dataset_id, run_id, count(*) AS n_items, {r4("avg(date_sub('millisecond', a, b))")} AS avg_latency_ms, {r4('sum(cost)')} AS total_cost, coalesce(sum(k), 0)::BIGINT AS n_scores, min(created_at) AS first_at
  FROM latest LEFT JOIN tr USING (project_id, trace_id) LEFT JOIN (SELECT trace_id, count(*) AS k FROM scores GROUP BY 1) USING (trace_id) GROUP BY 1, 2, 3""", _LATEST, _TR))
def _runs(spark, sf_dir):
    return datasets.run_metrics(star.run_items(spark, sf_dir), star.spans(spark, sf_dir), star.scores(spark, sf_dir))


@query("dataset_items_in_all_runs", oracle("SELECT project_id, dataset_id, item_id FROM run_items WHERE run_id IN ('F', 'O', 'P') GROUP BY 1, 2, 3 HAVING count(DISTINCT run_id) = 3"))
def _division(spark, sf_dir):
    return datasets.in_all_runs(star.run_items(spark, sf_dir), ["F", "O", "P"])


@query("dataset_compare_runs", oracle(f"""SELECT project_id, dataset_id, item_id, {r4("sum(cost) FILTER (run_id = 'F')")} AS "F", {r4("sum(cost) FILTER (run_id = 'O')")} AS "O" FROM latest LEFT JOIN tr USING (project_id, trace_id) WHERE run_id IN ('F', 'O') GROUP BY 1, 2, 3""", _LATEST, _TR))
def _compare(spark, sf_dir):
    return datasets.compare_runs(star.run_items(spark, sf_dir), star.spans(spark, sf_dir), ["F", "O"])


@query("dataset_versions_as_of", oracle("SELECT item_id, payload, valid_from, valid_to FROM item_versions WHERE valid_from <= TIMESTAMP '1998-03-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1998-03-01')"))
def _as_of(spark, sf_dir):
    return datasets.as_of(star.item_versions(spark, sf_dir), dt.datetime(1998, 3, 1))


_AT = "asked AS (SELECT l_orderkey || '-' || l_linenumber AS item_id, min(o_orderdate) AS at FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)"


@query("dataset_versions_at_runs", oracle("""SELECT a.item_id, a.at, v.payload, v.valid_from FROM asked a ASOF LEFT JOIN item_versions v ON a.item_id = v.item_id AND a.at >= v.valid_from""", _AT))
def _versions_at(spark, sf_dir):
    lines, orders = star.table(spark, sf_dir, "lineitem"), star.table(spark, sf_dir, "orders")
    asked = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.expr("concat(l_orderkey, '-', l_linenumber)").alias("item_id")).agg(F.min("o_orderdate").alias("at"))
    return datasets.versions_at_runs(star.item_versions(spark, sf_dir), asked)


@query("dataset_without_runs", oracle("SELECT DISTINCT project_id, trace_id FROM spans WHERE trace_id NOT IN (SELECT trace_id FROM run_items WHERE run_id = 'F')"))
def _without_runs(spark, sf_dir):
    return datasets.without_runs(star.spans(spark, sf_dir), star.run_items(spark, sf_dir).where("run_id = 'F'"))


# score analytics: clicks against purchases, on the trace
_S12 = "s1 AS (SELECT * FROM scores WHERE name = 'click'), s2 AS (SELECT * FROM scores WHERE name = 'purchase'), pairs AS (SELECT s1.value AS v1, s2.value AS v2, s1.timestamp AS t1 FROM s1 JOIN s2 USING (trace_id))"
_BIN = "floor((v{0} - l{0}) / ((h{0} - l{0} + 0.0001::DOUBLE) / 10))::BIGINT"


def _two(spark, sf_dir, a="click", b="purchase"):
    scores = star.scores(spark, sf_dir)
    first, second = sa.chosen(scores, a), sa.chosen(scores, b)
    return first, second, sa.matched(first, second, ("trace_id",))


@query("score_counts", oracle("SELECT (SELECT count(*) FROM s1) AS n1, (SELECT count(*) FROM s2) AS n2, (SELECT count(*) FROM pairs) AS n_matched", _S12))
def _score_counts(spark, sf_dir):
    return sa.counts(*_two(spark, sf_dir))


@query("score_matched", oracle("""SELECT a.id AS id1, b.id AS id2, a.value AS value1, b.value AS value2 FROM s1 a JOIN s2 b ON coalesce(a.trace_id, '') = coalesce(b.trace_id, '')
  AND coalesce(a.observation_id, '') = coalesce(b.observation_id, '') AND coalesce(a.run_id, '') = coalesce(b.run_id, '')""", _S12))
def _matched(spark, sf_dir):
    scores = star.scores(spark, sf_dir)
    return sa.matched(sa.chosen(scores, "click"), sa.chosen(scores, "purchase"), ("trace_id", "observation_id", "run_id")).select("id1", "id2", "value1", "value2")


@query("score_matched_all_keys", oracle("""SELECT count(*) AS n FROM scores a JOIN scores b ON a.trace_id = b.trace_id AND coalesce(a.observation_id, '') = coalesce(b.observation_id, '')
  AND coalesce(a.session_id, '') = coalesce(b.session_id, '') AND coalesce(a.run_id, '') = coalesce(b.run_id, '') WHERE a.name = 'click' AND b.name = 'click'"""))
def _matched_all(spark, sf_dir):
    first = sa.chosen(star.scores(spark, sf_dir), "click")
    return sa.matched(first, first).agg(F.count(F.lit(1)).alias("n"))


@query("score_heatmap", oracle(f"SELECT {_BIN.format(1)} AS bin_x, {_BIN.format(2)} AS bin_y, count(*) AS count FROM pairs, (SELECT min(v1) AS l1, max(v1) AS h1, min(v2) AS l2, max(v2) AS h2 FROM pairs) GROUP BY 1, 2", _S12))
def _heatmap(spark, sf_dir):
    return sa.heatmap(_two(spark, sf_dir)[2])


@query("score_confusion", oracle("SELECT coalesce(a.string_value, a.value::VARCHAR) AS category1, coalesce(b.string_value, b.value::VARCHAR) AS category2, count(*) AS count FROM scores a JOIN scores b USING (trace_id) WHERE a.name = 'error' AND b.name = 'signup' GROUP BY 1, 2"))
def _confusion(spark, sf_dir):
    return sa.confusion(_two(spark, sf_dir, "error", "signup")[2])


@query("score_distribution", oracle(f"SELECT {_BIN.format(1)} AS bin, count(*) AS count FROM (SELECT value AS v1 FROM s1), (SELECT min(value) AS l1, max(value) AS h1 FROM s1) GROUP BY 1", _S12))
def _distribution(spark, sf_dir):
    return sa.distribution(_two(spark, sf_dir)[0])


@query("score_shared_distribution", oracle(f"SELECT which, {_BIN.format(1)} AS bin, count(*) AS count FROM (SELECT 1::BIGINT AS which, value AS v1 FROM s1 UNION ALL SELECT 2, value FROM s2), (SELECT min(value) AS l1, max(value) AS h1 FROM scores WHERE name IN ('click', 'purchase')) GROUP BY 1, 2", _S12))
def _shared(spark, sf_dir):
    return sa.shared_distribution(*_two(spark, sf_dir)[:2])


@query("score_categories", oracle("SELECT string_value AS category, count(*) AS count, row_number() OVER (ORDER BY string_value) - 1 AS place FROM scores WHERE name = 'signup' GROUP BY 1"))
def _categories(spark, sf_dir):
    return sa.categories(sa.chosen(star.scores(spark, sf_dir), "signup"))


@query("score_stacked", oracle("SELECT a.string_value AS category1, coalesce(b.string_value, '__unmatched__') AS category2, count(*) AS count FROM (SELECT * FROM scores WHERE name = 'signup') a LEFT JOIN (SELECT * FROM scores WHERE name = 'error') b USING (trace_id) GROUP BY 1, 2"))
def _stacked(spark, sf_dir):
    first, second, _ = _two(spark, sf_dir, "signup", "error")
    return sa.stacked(first, second, ("trace_id",))


@query("score_timeseries", oracle(f"""SELECT time_dimension, {r4('avg1')} AS avg1, n1, {r4('avg2')} AS avg2, n2 FROM (SELECT date_trunc('hour', timestamp)::TIMESTAMP AS time_dimension, avg(value) AS avg1, count(*) AS n1 FROM s1 GROUP BY 1)
  FULL JOIN (SELECT date_trunc('hour', timestamp)::TIMESTAMP AS time_dimension, avg(value) AS avg2, count(*) AS n2 FROM s2 GROUP BY 1) USING (time_dimension)""", _S12))
def _timeseries(spark, sf_dir):
    return sa.timeseries(*_two(spark, sf_dir)[:2], "hour")


@query("score_timeseries_matched", oracle(f"SELECT date_trunc('day', t1)::TIMESTAMP AS time_dimension, {r4('avg(v1)')} AS avg1, {r4('avg(v2)')} AS avg2, count(*) AS count FROM pairs GROUP BY 1", _S12))
def _timeseries_matched(spark, sf_dir):
    return sa.timeseries_matched(_two(spark, sf_dir)[2], "day")


@query("score_timeseries_categories", oracle("SELECT date_trunc('week', timestamp)::TIMESTAMP AS time_dimension, string_value AS category, count(*) AS count FROM scores WHERE name = 'signup' GROUP BY 1, 2"))
def _timeseries_categories(spark, sf_dir):
    return sa.timeseries_categories(sa.chosen(star.scores(spark, sf_dir), "signup"), "week")


@query("score_statistics", oracle(f"""SELECT count(*) AS n_matched, {r4('corr(v1, v2)')} AS pearson, {r4('avg(abs(v1 - v2))')} AS mae, {r4('sqrt(avg((v1 - v2) * (v1 - v2)))')} AS rmse, {r4('corr(r1, r2)')} AS spearman,
  {r4('(SELECT avg(value) FROM s1)')} AS mean1, {r4('(SELECT stddev_pop(value) FROM s1)')} AS std1, {r4('(SELECT avg(value) FROM s2)')} AS mean2, {r4('(SELECT stddev_pop(value) FROM s2)')} AS std2
  FROM (SELECT v1, v2, rank() OVER (ORDER BY v1) + (count(*) OVER (PARTITION BY v1) - 1) / 2.0::DOUBLE AS r1, rank() OVER (ORDER BY v2) + (count(*) OVER (PARTITION BY v2) - 1) / 2.0::DOUBLE AS r2 FROM pairs)""", _S12))
def _statistics(spark, sf_dir):
    return sa.statistics(*_two(spark, sf_dir))


@query("score_agreement", f"""WITH n AS (SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS same, count(*) FILTER (quality = 1) AS a1, count(*) FILTER (toxic = 1) AS b1, count(*) FILTER (quality = 1 AND toxic = 1) AS h1, count(*) FILTER (quality = 0 AND toxic = 0) AS h0 FROM labels)
  SELECT n, {r4('same / n')} AS agreement, {r4('(same / n - (a1 * b1 + (n - a1) * (n - b1)) / (n * n)) / (1 - (a1 * b1 + (n - a1) * (n - b1)) / (n * n))')} AS kappa,
  {r4('(a1 * (2 * h1 / (a1 + b1)) + (n - a1) * (2 * h0 / (2 * n - a1 - b1))) / n')} AS weighted_f1 FROM n""")
def _agreement(spark, sf_dir):
    table = star.table(spark, sf_dir, "labels").groupBy(F.col("quality").cast("string").alias("category1"), F.col("toxic").cast("string").alias("category2")).agg(F.count(F.lit(1)).alias("count"))
    return sa.agreement(table)


@query("score_sample", oracle("SELECT count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM scores WHERE ('0x' || left(sha256(concat_ws('|', coalesce(trace_id, ''), coalesce(observation_id, ''), coalesce(session_id, ''))), 8))::BIGINT / 4294967295.0::DOUBLE < 0.25"))
def _sample(spark, sf_dir):
    return sa.sample(star.scores(spark, sf_dir), 0.25).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


# search over documents and events
_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def _search(name, where, make):
    query(name, f"SELECT doc_id FROM documents WHERE {where}")(lambda spark, sf_dir: star.table(spark, sf_dir, "documents").where(make()).select("doc_id"))


_search("search_contains", "contains(text, 'License')", lambda: F.col("text").contains("License"))
_search("search_any", f"list_has_any({_TOK}, ['apache', 'idiot'])", lambda: search.match_any("text", "Apache idiot"))
_search("search_all", f"list_has_all({_TOK}, ['licensed', 'version'])", lambda: search.match_all("text", "version Licensed"))
_search("search_phrase", r"regexp_matches(lower(text), '(^|[^\p{L}\p{N}])licensed[^\p{L}\p{N}]+under[^\p{L}\p{N}]+the([^\p{L}\p{N}]|$)')", lambda: search.match_phrase("text", "Licensed under the"))
_search("search_phrase_prefix", r"regexp_matches(lower(text), '(^|[^\p{L}\p{N}])under[^\p{L}\p{N}]+the[^\p{L}\p{N}]+apa')", lambda: search.match_phrase("text", "under the apa", prefix=True))
_search("search_keyword", f"list_has_any({_TOK}, ['997']) OR n_chars = 997", lambda: search.keyword("997", ["text"], ["n_chars"]))
_FIELDS = {"text": "text", "lang": "lang", "source": "source", "n": "n_chars", "id": "doc_id"}
for _name, _q, _where in (
    ("and_not", "lang:fr AND NOT source:src1*", "lang = 'fr' AND NOT starts_with(source, 'src1')"),
    ("or_group", "(lang:de OR lang:es) n:>=2000", "(lang = 'de' OR lang = 'es') AND n_chars >= 2000"),
    ("range", "n:[100 TO 500] -lang:en", "n_chars BETWEEN 100 AND 500 AND NOT lang = 'en'"),
    ("phrase", '"licensed under" || worthless', rf"regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}])licensed[^\p{{L}}\p{{N}}]+under([^\p{{L}}\p{{N}}]|$)') OR list_contains({_TOK}, 'worthless')"),
    ("field_exists", "source:* && source:*7 && !unknown:x", "source <> '' AND source LIKE '%7'"),
):
    _search(f"lucene_{_name}", _where, lambda q=_q: search.Lucene(_FIELDS, ["text"]).parse(q))


@query("search_by_id", oracle("SELECT span_id FROM spans WHERE contains(span_id, '99-') OR contains(user_id, 'u149')"))
def _by_id(spark, sf_dir):
    rows = star.spans(spark, sf_dir)
    return search.by_id(rows, "99-", "span_id").unionByName(search.by_id(rows, "u149", "user_id").where("NOT contains(span_id, '99-')")).select("span_id")


@query("search_chart", "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS time_dimension, count(*) AS count FROM events WHERE contains(props, '9') GROUP BY 1")
def _chart(spark, sf_dir):
    return search.chart(star.table(spark, sf_dir, "events").where(F.col("props").contains("9")), "ts", 3600)


@query("search_path_filter", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k')::BIGINT BETWEEN 10 AND 12")
def _path_filter(spark, sf_dir):
    c = search.field("props.k", {"props": "props"}).cast("bigint")
    return star.table(spark, sf_dir, "events").where(search.field_condition(c, "between", (10, 12))).select("event_id")


# trees
_UP = "WITH RECURSIVE" + oracle("", "up AS (SELECT project_id, trace_id, span_id, span_id AS ancestor, 0 AS distance FROM spans UNION ALL SELECT u.project_id, u.trace_id, u.span_id, s.parent_span_id, u.distance + 1 FROM up u JOIN spans s ON s.project_id = u.project_id AND s.trace_id = u.trace_id AND s.span_id = u.ancestor JOIN spans p ON p.project_id = s.project_id AND p.trace_id = s.trace_id AND p.span_id = s.parent_span_id WHERE s.parent_span_id <> '')")[4:]


@query("tree_descendants", _UP + " SELECT project_id, trace_id, ancestor, span_id, distance::BIGINT AS distance FROM up WHERE ancestor LIKE 'r%' AND distance > 0")
def _descendants(spark, sf_dir):
    spans = star.spans(spark, sf_dir)
    return tree.descendants(spans, tables.roots(spans)).where("distance > 0")


@query("tree_recursive_cost", _UP + f" SELECT u.project_id, u.trace_id, u.ancestor AS span_id, {r4('nullif(sum(CASE WHEN coalesce(s.total_cost, 0) <> 0 THEN s.total_cost ELSE coalesce(s.c_input, 0) + coalesce(s.c_output, 0) END), 0)')} AS total_cost, count(*) - 1 AS n_descendants, max(u.distance)::BIGINT AS height FROM up u JOIN spans s USING (project_id, trace_id, span_id) GROUP BY 1, 2, 3")
def _recursive_cost(spark, sf_dir):
    return tree.recursive_cost(star.spans(spark, sf_dir))


@query("tree_propagate", _UP + " SELECT project_id, trace_id, span_id, arg_min(run, distance) AS run FROM (SELECT u.*, 'x' || ancestor AS run FROM up u WHERE ancestor LIKE 'r%' OR ancestor LIKE '%-2') GROUP BY 1, 2, 3")
def _propagate(spark, sf_dir):
    spans = star.spans(spark, sf_dir)
    marks = spans.where("span_id LIKE 'r%' OR span_id LIKE '%-2'").withColumn("run", F.concat(F.lit("x"), "span_id"))
    return tree.propagate(spans, marks, "run")


def _chains(spark, sf_dir):
    """A chain a customer: each order's span hangs below the customer's order before it."""
    return star.table(spark, sf_dir, "orders").selectExpr(
        "'p' AS project_id", "cast(o_custkey AS string) AS trace_id", "cast(o_orderkey AS string) AS span_id", "coalesce(cast(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS string), '') AS parent_span_id",
        "cast(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_totalprice END AS decimal(18, 8)) AS total_cost", "map('input', cast(o_custkey % 5 AS decimal(18, 8)), 'output', cast(o_orderkey % 7 AS decimal(18, 8))) AS cost_details")


_CHAIN = "chain AS (SELECT o_custkey::VARCHAR AS trace_id, o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_totalprice = 0 THEN o_custkey % 5 + o_orderkey % 7 ELSE o_totalprice END::DECIMAL(18, 8) AS cost FROM orders)"
_BELOW = "OVER (PARTITION BY trace_id ORDER BY o_orderkey DESC)"


@query("tree_deep_cost", oracle(f"SELECT trace_id, o_orderkey::VARCHAR AS span_id, {r4(f'nullif(sum(cost) {_BELOW}, 0)')} AS total_cost, count(*) {_BELOW} - 1 AS n_descendants, count(*) {_BELOW} - 1 AS height FROM chain", _CHAIN))
def _deep_cost(spark, sf_dir):
    return tree.recursive_cost(_chains(spark, sf_dir)).drop("project_id")


@query("tree_deep_backfill", oracle("SELECT trace_id, o_orderkey::VARCHAR AS span_id, first_value(o_orderkey) OVER (PARTITION BY trace_id ORDER BY o_orderkey)::VARCHAR AS run_id, 'i' || trace_id AS item_id FROM chain", _CHAIN))
def _deep_backfill(spark, sf_dir):
    spans = _chains(spark, sf_dir)
    items = spans.where("parent_span_id = ''").select("project_id", "trace_id", F.lit(None).cast("string").alias("observation_id"), F.lit(dt.datetime(2024, 1, 1)).alias("created_at"), F.lit(1).alias("seq"), F.col("span_id").alias("run_id"), F.concat(F.lit("i"), "trace_id").alias("item_id"))
    return datasets.backfill(spans, items, items.limit(0)).drop("project_id")


@query("export_score_columns", oracle(f"""SELECT trace_id, span_id, {r4("avg(value) FILTER (s.name = 'click')")} AS click, {r4("avg(value) FILTER (s.name = 'view')")} AS view FROM root r LEFT JOIN scores s USING (trace_id) GROUP BY 1, 2"""))
def _export(spark, sf_dir):
    return sinks.with_score_columns(tables.roots(star.spans(spark, sf_dir)).select("trace_id", "span_id"), star.scores(spark, sf_dir), ["click", "view"])


@query("export_window", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
def _export_window(spark, sf_dir):
    return sinks.window_of(star.table(spark, sf_dir, "events"), "ts", dt.datetime(2024, 1, 10), dt.datetime(2024, 2, 1), "daily").select("event_id")


@query("hash_sample", "SELECT event_id FROM events WHERE ('0x' || left(sha256(event_id::VARCHAR), 8))::BIGINT / 4294967295.0::DOUBLE < 0.1")
def _hash_sample(spark, sf_dir):
    return star.table(spark, sf_dir, "events").where(scalars.sampled(F.col("event_id").cast("string"), 0.1)).select("event_id")


@query("experiment_backfill", _UP + " SELECT u.project_id, u.trace_id, u.span_id, run_id, item_id FROM up u JOIN run_items i USING (project_id, trace_id) WHERE ancestor LIKE 'r%' AND run_id <> 'P'")
def _backfill(spark, sf_dir):
    items = star.run_items(spark, sf_dir)
    return datasets.backfill(star.spans(spark, sf_dir), items, items.where("run_id = 'P'"))


@query("read_bound_sql", oracle("SELECT trace_id, count(*) AS n FROM spans WHERE level = 'WARNING' AND start_time >= TIMESTAMP '1999-01-01' GROUP BY 1"))
def _bound(spark, sf_dir):
    sql = "SELECT trace_id, count(*) AS n FROM {spans} WHERE level = :level AND start_time >= cast(:since AS timestamp_ntz) GROUP BY trace_id"
    return reader.query(spark, sql, {"level": "WARNING", "since": "1999-01-01"}, spans=star.spans(spark, sf_dir))


@query("read_large_fields", oracle("SELECT c.project_id, c.trace_id, c.span_id, left(c.name, 4) AS name FROM child c WHERE level = 'ERROR' AND environment = 'F'"))
def _large(spark, sf_dir):
    spans = star.spans(spark, sf_dir)
    return reader.large_fields(spans, spans.where("level = 'ERROR' AND environment = 'F'"), ["name"], 4)


@query("traces_with_errors", oracle("SELECT DISTINCT project_id, trace_id FROM child WHERE level = 'ERROR' AND environment = 'O'"))
def _with_errors(spark, sf_dir):
    return reader.traces_having(star.spans(spark, sf_dir), F.col("environment") == "O", "ERROR")
