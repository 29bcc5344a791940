"""The driver's star tables read as spans, scores, dataset runs and versions (the mapping of FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN_COLUMNS = (
    "project_id", "trace_id", "span_id", "parent_span_id", "name", "trace_name", "type", "level", "environment", "user_id", "session_id", "release", "version",
    "start_time", "end_time", "completion_start_time", "event_ts", "provided_model_name", "prompt_name", "prompt_version", "tags", "usage_details", "cost_details",
    "total_cost", "tool_definitions", "tool_call_names", "metadata",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order_columns(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "concat('p', o_custkey % 3) AS project_id", "cast(o_orderkey AS string) AS trace_id", "o_orderpriority AS trace_name", "o_orderstatus AS environment",
        "CASE WHEN o_custkey % 20 = 0 THEN '' ELSE concat('u', o_custkey) END AS user_id", "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE concat('s', o_custkey % 100) END AS session_id",
        "concat('rel-', o_orderkey % 4) AS release", "concat('v', o_orderkey % 3) AS version", "array(o_orderpriority, o_orderstatus) AS tags")


def root_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_columns(table(spark, sf_dir, "orders")).selectExpr(
        "project_id", "trace_id", "concat('r', o_orderkey) AS span_id", "'' AS parent_span_id", "trace_name AS name", "trace_name", "'SPAN' AS type", "'DEFAULT' AS level", "environment", "user_id", "session_id",
        "release", "version", "o_orderdate AS start_time", "timestampadd(SECOND, cast(o_orderkey % 600 AS int), o_orderdate) AS end_time", "cast(NULL AS timestamp_ntz) AS completion_start_time", "o_orderdate AS event_ts",
        "cast(NULL AS string) AS provided_model_name", "cast(NULL AS string) AS prompt_name", "cast(NULL AS string) AS prompt_version", "tags", "cast(NULL AS map<string, bigint>) AS usage_details",
        "cast(NULL AS map<string, decimal(18, 8)>) AS cost_details", "cast(NULL AS decimal(18, 8)) AS total_cost", "cast(NULL AS map<string, string>) AS tool_definitions", "cast(array() AS array<string>) AS tool_call_names",
        "map('price', cast(cast(o_totalprice AS bigint) AS string)) AS metadata")


def span_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored version of the child spans: the key repeats, event_ts tells them apart."""
    return table(spark, sf_dir, "lineitem").withColumn("span_id", F.expr("concat(l_orderkey, '-', l_linenumber)")).withColumn("event_ts", F.col("l_shipdate"))


def latest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each line: a struct maximum, which combines before the shuffle as a window would not."""
    best = F.max(F.struct("l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")).alias("x")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(best).select("l_orderkey", "l_linenumber", "x.*")


def child_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest_lines(spark, sf_dir).join(_order_columns(table(spark, sf_dir, "orders")), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.withColumns({
        "c_in": F.expr("cast(l_extendedprice * (1 - l_discount) / 1000 AS decimal(18, 8))"), "c_out": F.expr("cast(l_extendedprice * l_tax / 1000 AS decimal(18, 8))"),
        "began": F.expr("timestampadd(SECOND, l_linenumber, o_orderdate)")})
    return rows.selectExpr(
        "project_id", "trace_id", "concat(l_orderkey, '-', l_linenumber) AS span_id",
        "CASE WHEN l_linenumber = 1 THEN concat('r', l_orderkey) ELSE concat(l_orderkey, '-', l_linenumber div 2) END AS parent_span_id", "concat('step-', l_linenumber) AS name", "trace_name",
        "CASE WHEN l_returnflag <> 'N' THEN 'GENERATION' ELSE 'SPAN' END AS type", "CASE WHEN l_linestatus = 'F' AND l_linenumber = 7 THEN 'ERROR' WHEN l_linenumber = 6 THEN 'WARNING' ELSE 'DEFAULT' END AS level",
        "environment", "user_id", "session_id", "release", "version", "began AS start_time", "timestampadd(SECOND, cast(l_quantity AS int), began) AS end_time",
        "CASE WHEN l_returnflag = 'N' THEN NULL ELSE timestampadd(SECOND, 1, began) END AS completion_start_time", "l_shipdate AS event_ts", "concat('model-', l_returnflag) AS provided_model_name",
        "CASE WHEN l_returnflag <> 'N' THEN concat('prompt-', l_partkey % 5) END AS prompt_name", "CASE WHEN l_returnflag <> 'N' THEN cast(l_suppkey % 3 AS string) END AS prompt_version", "tags",
        "CASE WHEN l_linenumber = 5 THEN NULL ELSE map('input', cast(l_quantity AS bigint), 'cache_read_input', cast(l_linenumber AS bigint), 'output', l_partkey % 100, 'total', cast(l_quantity AS bigint) + l_linenumber + l_partkey % 100) END AS usage_details",
        "map('input', c_in, 'output', c_out, 'total', cast(c_in + c_out AS decimal(18, 8))) AS cost_details", "cast(c_in + c_out AS decimal(18, 8)) AS total_cost",
        "CASE WHEN l_linenumber % 3 = 0 THEN map() ELSE map_from_arrays(transform(sequence(1, l_linenumber % 3), i -> concat('t', i)), transform(sequence(1, l_linenumber % 3), i -> '{}')) END AS tool_definitions",
        "CASE WHEN l_linenumber % 3 = 0 THEN cast(array() AS array<string>) ELSE transform(sequence(1, l_linenumber % 3), i -> concat('t', i)) END AS tool_call_names",
        "map('part', cast(l_partkey AS string), 'supp', cast(l_suppkey AS string)) AS metadata")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root spans (traces) and child spans."""
    return root_spans(spark, sf_dir).unionByName(child_spans(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "cast(event_id AS string) AS id", "cast(event_id div 5 AS string) AS trace_id", "CASE WHEN event_id % 4 = 0 THEN concat(event_id div 5, '-', 1 + event_id % 7) END AS observation_id",
        "concat('s', user_id % 100) AS session_id", "concat('u', user_id) AS author", "'default' AS environment", "event_type AS name", "CASE event_id % 3 WHEN 0 THEN 'API' WHEN 1 THEN 'EVAL' ELSE 'ANNOTATION' END AS source",
        "CASE event_type WHEN 'error' THEN 'BOOLEAN' WHEN 'signup' THEN 'CATEGORICAL' ELSE 'NUMERIC' END AS data_type",
        "CASE event_type WHEN 'error' THEN CASE WHEN value > 50 THEN 1D ELSE 0D END WHEN 'signup' THEN cast(NULL AS double) ELSE value END AS value",
        "CASE event_type WHEN 'error' THEN CASE WHEN value > 50 THEN 'True' ELSE 'False' END WHEN 'signup' THEN CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'mid' ELSE 'high' END END AS string_value",
        "CASE WHEN event_id % 6 = 0 THEN concat('run', event_id div 5 % 3) END AS run_id", "ts AS timestamp", "props AS metadata", "event_id")


def run_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset run items: a run per order status, an item per customer, re-run whenever the customer orders again."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('p', o_custkey % 3) AS project_id", "'ds' AS dataset_id", "o_orderstatus AS run_id", "cast(o_custkey AS string) AS item_id", "cast(o_orderkey AS string) AS trace_id", "cast(NULL AS string) AS observation_id", "o_orderdate AS created_at", "o_orderkey AS seq")


def item_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset items with validity intervals: a version holds until the next one of its item begins."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_shipdate").agg(F.max("l_quantity").alias("payload"))
    return rows.selectExpr("concat(l_orderkey, '-', l_linenumber) AS item_id", "payload", "l_shipdate AS valid_from", "lead(l_shipdate) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate) AS valid_to")


#: The same for DuckDB; maps are spelled out as columns.
ORACLE = """
WITH o AS (
  SELECT *, 'p' || (o_custkey % 3) AS project_id, o_orderkey::VARCHAR AS trace_id, o_orderpriority AS trace_name, o_orderstatus AS environment,
    CASE WHEN o_custkey % 20 = 0 THEN '' ELSE 'u' || o_custkey END AS user_id, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 's' || (o_custkey % 100) END AS session_id,
    'rel-' || (o_orderkey % 4) AS release, 'v' || (o_orderkey % 3) AS version, [o_orderpriority, o_orderstatus] AS tags FROM orders),
line AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1),
root AS (
  SELECT project_id, trace_id, 'r' || o_orderkey AS span_id, '' AS parent_span_id, trace_name AS name, trace_name, 'SPAN' AS type, 'DEFAULT' AS level, environment, user_id, session_id, release, version,
    o_orderdate AS start_time, o_orderdate + to_seconds(o_orderkey % 600) AS end_time, NULL::TIMESTAMP AS completion_start_time, o_orderdate AS event_ts, NULL::VARCHAR AS provided_model_name,
    NULL::VARCHAR AS prompt_name, NULL::VARCHAR AS prompt_version, tags, NULL::BIGINT AS u_input, NULL::BIGINT AS u_cache, NULL::BIGINT AS u_output, NULL::BIGINT AS u_total,
    NULL::DECIMAL(18,8) AS c_input, NULL::DECIMAL(18,8) AS c_output, NULL::DECIMAL(18,8) AS total_cost, []::VARCHAR[] AS tools, NULL::VARCHAR AS part, NULL::VARCHAR AS supp, 0 AS line FROM o),
child AS (
  SELECT project_id, trace_id, l_orderkey || '-' || l_linenumber AS span_id,
    CASE WHEN l_linenumber = 1 THEN 'r' || l_orderkey ELSE l_orderkey || '-' || (l_linenumber // 2) END AS parent_span_id, 'step-' || l_linenumber AS name, trace_name,
    CASE WHEN l_returnflag <> 'N' THEN 'GENERATION' ELSE 'SPAN' END AS type, CASE WHEN l_linestatus = 'F' AND l_linenumber = 7 THEN 'ERROR' WHEN l_linenumber = 6 THEN 'WARNING' ELSE 'DEFAULT' END AS level,
    environment, user_id, session_id, release, version, o_orderdate + to_seconds(l_linenumber) AS start_time, o_orderdate + to_seconds(l_linenumber + l_quantity::INT) AS end_time,
    CASE WHEN l_returnflag = 'N' THEN NULL ELSE o_orderdate + to_seconds(l_linenumber + 1) END AS completion_start_time, l_shipdate AS event_ts, 'model-' || l_returnflag AS provided_model_name,
    CASE WHEN l_returnflag <> 'N' THEN 'prompt-' || (l_partkey % 5) END AS prompt_name, CASE WHEN l_returnflag <> 'N' THEN (l_suppkey % 3)::VARCHAR END AS prompt_version, tags,
    CASE WHEN l_linenumber <> 5 THEN l_quantity::BIGINT END AS u_input, CASE WHEN l_linenumber <> 5 THEN l_linenumber::BIGINT END AS u_cache, CASE WHEN l_linenumber <> 5 THEN l_partkey % 100 END AS u_output,
    CASE WHEN l_linenumber <> 5 THEN l_quantity::BIGINT + l_linenumber + l_partkey % 100 END AS u_total,
    (l_extendedprice * (1 - l_discount) / 1000)::DECIMAL(18,8) AS c_input, (l_extendedprice * l_tax / 1000)::DECIMAL(18,8) AS c_output,
    ((l_extendedprice * (1 - l_discount) / 1000)::DECIMAL(18,8) + (l_extendedprice * l_tax / 1000)::DECIMAL(18,8))::DECIMAL(18,8) AS total_cost,
    list_transform(range(1, l_linenumber % 3 + 1), lambda i: 't' || i) AS tools, l_partkey::VARCHAR AS part, l_suppkey::VARCHAR AS supp, l_linenumber AS line
  FROM line JOIN o ON l_orderkey = o_orderkey),
spans AS (SELECT * FROM root UNION ALL SELECT * FROM child),
scores AS (
  SELECT event_id::VARCHAR AS id, (event_id // 5)::VARCHAR AS trace_id, CASE WHEN event_id % 4 = 0 THEN (event_id // 5) || '-' || (1 + event_id % 7) END AS observation_id, 's' || (user_id % 100) AS session_id,
    'u' || user_id AS author, 'default' AS environment, event_type AS name, CASE event_id % 3 WHEN 0 THEN 'API' WHEN 1 THEN 'EVAL' ELSE 'ANNOTATION' END AS source,
    CASE event_type WHEN 'error' THEN 'BOOLEAN' WHEN 'signup' THEN 'CATEGORICAL' ELSE 'NUMERIC' END AS data_type,
    CASE event_type WHEN 'error' THEN CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN 'signup' THEN NULL ELSE value END AS value,
    CASE event_type WHEN 'error' THEN CASE WHEN value > 50 THEN 'True' ELSE 'False' END WHEN 'signup' THEN CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'mid' ELSE 'high' END END AS string_value,
    CASE WHEN event_id % 6 = 0 THEN 'run' || (event_id // 5 % 3) END AS run_id, ts AS timestamp, props AS metadata, event_id FROM events),
run_items AS (
  SELECT 'p' || (o_custkey % 3) AS project_id, 'ds' AS dataset_id, o_orderstatus AS run_id, o_custkey::VARCHAR AS item_id, o_orderkey::VARCHAR AS trace_id, NULL::VARCHAR AS observation_id, o_orderdate AS created_at, o_orderkey AS seq FROM orders),
item_versions AS (
  SELECT l_orderkey || '-' || l_linenumber AS item_id, payload, l_shipdate AS valid_from, lead(l_shipdate) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate) AS valid_to
  FROM (SELECT l_orderkey, l_linenumber, l_shipdate, max(l_quantity) AS payload FROM lineitem GROUP BY ALL))
"""


def oracle(select: str, *more: str) -> str:
    """DuckDB SQL over the mapped tables; ``more``: further common tables as 'name AS (...)'."""
    return ORACLE.strip() + "".join(f",\n{x.strip()}" for x in more) + "\n" + select.strip()
