"""Ingestion, pricing, retention and updates as named queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from spanlight.operators import filters
from spanlight.sources import sinks, star
from spanlight.sources.star import oracle
from spanlight.streaming import ingest

from .registry import query, r4


@query("latest_version", oracle("SELECT l_orderkey || '-' || l_linenumber AS span_id, l_shipdate AS event_ts, l_partkey, l_quantity FROM line"))
def _latest(spark, sf_dir):
    return star.latest_lines(spark, sf_dir).select(F.expr("concat(l_orderkey, '-', l_linenumber)").alias("span_id"), F.col("l_shipdate").alias("event_ts"), "l_partkey", "l_quantity")


def _records(spark, sf_dir):
    """Each stored version of a line as a record: the creates are those of flag A; a quantity above 40 is not set."""
    return star.table(spark, sf_dir, "lineitem").selectExpr(
        "concat(l_orderkey, '-', l_linenumber) AS id", "CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS rank", "l_shipdate AS timestamp", "struct(l_extendedprice, l_partkey, l_suppkey) AS seq",
        "CASE WHEN l_quantity > 40 THEN array('start_time', 'name', 'tags', 'metadata') ELSE array('start_time', 'name', 'amount', 'tags', 'metadata') END AS set",
        "l_shipdate AS start_time", "concat('n', l_partkey % 7) AS name", "l_quantity AS amount", "array(l_linestatus, l_returnflag) AS tags", "map(concat('k', l_suppkey % 3), cast(l_partkey AS string)) AS metadata")


_REC = """rec AS (SELECT l_orderkey || '-' || l_linenumber AS id, (CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END, l_shipdate, l_extendedprice, l_partkey, l_suppkey) AS o, l_shipdate AS start_time, 'n' || (l_partkey % 7) AS name, l_quantity AS amount,
  [l_linestatus, l_returnflag] AS tags, 'k' || (l_suppkey % 3) AS mk, l_partkey::VARCHAR AS mv FROM lineitem)"""


@query("ingest_merge", oracle("""SELECT id, arg_min(start_time, o) AS start_time, arg_max(name, o) AS name, arg_max(amount, o) FILTER (amount <= 40) AS amount, list_sort(list_distinct(flatten(list(tags)))) AS tags,
  arg_max(mv, o) FILTER (mk = 'k0') AS k0, arg_max(mv, o) FILTER (mk = 'k1') AS k1, arg_max(mv, o) FILTER (mk = 'k2') AS k2 FROM rec GROUP BY 1""", _REC))
def _merge(spark, sf_dir):
    out = ingest.merged(_records(spark, sf_dir), ["id"])
    return out.select("id", "start_time", "name", "amount", "tags", *(F.col("metadata")[k].alias(k) for k in ("k0", "k1", "k2")))


_MODELS = [("m-any", None, "^model-", dt.date(2020, 1, 1)), ("m-a", None, "^model-A$", dt.date(2021, 1, 1)), ("m-r1", "p1", "^model-R$", dt.date(2019, 1, 1))]
_TIERS = [("m-any", 9, "t-any", True, []), ("m-a", 9, "t-a", True, []), ("m-a", 1, "t-a-long", False, [(".*input.*", ">", 30)]), ("m-r1", 9, "t-r1", True, []), ("m-r1", 2, "t-r1-out", False, [("^output$", ">=", 50), ("input", "<", 100)])]
_PRICES = [("t-any", "input", 0.001), ("t-any", "output", 0.002), ("t-a", "input", 0.003), ("t-a", "output", 0.004), ("t-a-long", "input", 0.006), ("t-a-long", "output", 0.008), ("t-r1", "output", 0.01), ("t-r1-out", "input", 0.02), ("t-r1-out", "output", 0.03)]


def _priced(spark, sf_dir):
    models = spark.createDataFrame(_MODELS, "model_id string, project_id string, match_pattern string, start_date date")
    tiers = spark.createDataFrame(_TIERS, "model_id string, priority int, tier_id string, is_default boolean, conditions array<struct<pattern: string, op: string, value: bigint>>")
    prices = spark.createDataFrame(_PRICES, "tier_id string, usage_type string, price double")
    spans = star.child_spans(spark, sf_dir).withColumn("cost_details", F.expr("CASE WHEN span_id LIKE '%-2' THEN cost_details END"))
    return ingest.priced(ingest.match_tiers(ingest.match_models(spans, models), tiers), prices)


@query("ingest_pricing", oracle(f"""SELECT span_id, model_id, tier_id, CASE WHEN line = 2 THEN {r4('child_cost')} ELSE {r4('computed')} END AS total_cost FROM (
  SELECT *, u_input * CASE tier_id WHEN 't-any' THEN 0.001 WHEN 't-a' THEN 0.003 WHEN 't-a-long' THEN 0.006 WHEN 't-r1-out' THEN 0.02 ELSE 0 END + u_output * CASE tier_id WHEN 't-any' THEN 0.002 WHEN 't-a' THEN 0.004 WHEN 't-a-long' THEN 0.008 WHEN 't-r1' THEN 0.01 ELSE 0.03 END AS computed FROM (
    SELECT span_id, line, u_input, u_output, total_cost AS child_cost, model_id, CASE model_id WHEN 'm-any' THEN 't-any' WHEN 'm-a' THEN CASE WHEN u_input + u_cache > 30 THEN 't-a-long' ELSE 't-a' END
      ELSE CASE WHEN u_output >= 50 AND u_input + u_cache < 100 THEN 't-r1-out' ELSE 't-r1' END END AS tier_id FROM (
      SELECT *, CASE WHEN provided_model_name = 'model-R' AND project_id = 'p1' THEN 'm-r1' WHEN provided_model_name = 'model-A' THEN 'm-a' ELSE 'm-any' END AS model_id FROM child)))"""))
def _pricing(spark, sf_dir):
    return _priced(spark, sf_dir).select("span_id", "model_id", "tier_id", "total_cost")


@query("ingest_usage", oracle("SELECT span_id, u_input + u_output AS total FROM child WHERE line <> 5"))
def _usage(spark, sf_dir):
    rows = star.child_spans(spark, sf_dir).where("usage_details is not null")
    raw = F.expr("map('input', usage_details['input'], 'output', usage_details['output'], 'broken', -5L)")
    return rows.select("span_id", ingest.clean_usage(raw)["total"].alias("total"))


@query("ingest_token_count", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS tokens FROM documents")
def _token_count(spark, sf_dir):
    return star.table(spark, sf_dir, "documents").select("doc_id", ingest.token_count("text").alias("tokens"))


@query("ingest_last_truthy", oracle("SELECT trace_id, arg_max(prompt_name, (event_ts, span_id)) AS prompt FROM child GROUP BY 1"))
def _last_truthy(spark, sf_dir):
    return star.child_spans(spark, sf_dir).groupBy("trace_id").agg(ingest.last_truthy("prompt_name", "event_ts", "span_id").alias("prompt"))


@query("ingest_parse", "SELECT type, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT 'e' || event_id AS id, CASE event_type WHEN 'click' THEN 'trace-create' ELSE 'span-update' END AS type FROM events WHERE event_type <> 'error') GROUP BY 1")
def _parse(spark, sf_dir):
    rows = star.table(spark, sf_dir, "events").select(F.to_json(F.struct(
        F.concat(F.lit("e"), "event_id").alias("id"), F.expr("CASE event_type WHEN 'click' THEN 'trace-create' WHEN 'error' THEN 'nonsense' ELSE 'span-update' END").alias("type"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.struct(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("name")).alias("body"))).alias("value"))
    return ingest.parse_events(rows)[0].groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query("retention", oracle("SELECT project_id, count(*) AS n FROM spans WHERE NOT (project_id = 'p0' AND start_time < TIMESTAMP '1999-01-01') AND NOT (project_id = 'p2' AND start_time < TIMESTAMP '1997-07-01') GROUP BY 1"))
def _retention(spark, sf_dir):
    cutoffs = spark.createDataFrame([("p0", dt.datetime(1999, 1, 1)), ("p2", dt.datetime(1997, 7, 1))], "project_id string, cutoff timestamp_ntz")
    return sinks.retained(star.spans(spark, sf_dir), cutoffs, "start_time").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


@query("delete_preflight", oracle("SELECT count(*) AS n FROM spans WHERE level = 'ERROR'"))
def _delete(spark, sf_dir):
    return sinks.deleted(star.spans(spark, sf_dir), F.col("level") == "ERROR")[1]


@query("partial_update", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment, c_name FROM customer")
def _update(spark, sf_dir):
    rows = star.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    return sinks.updated(rows, rows.where("c_custkey % 10 = 0").select("c_custkey", F.lit("CHANGED").alias("c_mktsegment")), ["c_custkey"])


@query("filter_by_comment_count", oracle("SELECT trace_id FROM root WHERE trace_id NOT IN (SELECT trace_id FROM scores WHERE name = 'error' GROUP BY 1 HAVING count(*) > 1)"))
def _comments(spark, sf_dir):
    return filters.by_counts(star.root_spans(spark, sf_dir), "trace_id", star.scores(spark, sf_dir).where("name = 'error'"), "trace_id", 0, 1).select("trace_id")


@query("filter_by_comment_count_least", oracle("SELECT trace_id FROM root WHERE trace_id IN (SELECT trace_id FROM scores WHERE name = 'view' GROUP BY 1 HAVING count(*) >= 2)"))
def _comments_least(spark, sf_dir):
    return filters.by_counts(star.root_spans(spark, sf_dir), "trace_id", star.scores(spark, sf_dir).where("name = 'view'"), "trace_id", 2).select("trace_id")
