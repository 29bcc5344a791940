"""Ingestion: events become records, records of one key are merged, tokens are counted and priced.

The merge of a key's records is a fold over a sorted array inside one aggregate, so a batch costs one shuffle by key. Rules:
creates come before updates, then time, then arrival. A column is taken from the last record that sets it, where a record
sets what its ``set`` list names: a set NULL overwrites, an absent or empty one does not. Immutable columns keep the first
value that was set. Metadata maps are united, later values first; tags are united and sorted. An end before the start is the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanlight.session import cut, sized

#: Columns that are never overwritten once set.
IMMUTABLE = ("id", "project_id", "trace_id", "start_time", "created_at", "environment")
EVENT_SCHEMA = """id string, type string, timestamp timestamp, body struct<id string, traceId string, parentObservationId string, projectId string, name string, userId string, sessionId string,
 environment string, level string, model string, startTime timestamp, endTime timestamp, completionStartTime timestamp, input string, output string, tags array<string>, metadata map<string, string>,
 usage map<string, bigint>, cost map<string, decimal(38, 12)>, version string, release string,
 observationId string, value string, stringValue string, dataType string, comment string, source string, configId string, queueId string, datasetRunId string>"""
#: Event types by the kind of record they make.
KINDS = {
    "trace-create": "trace", "span-create": "span", "span-update": "span", "generation-create": "span", "generation-update": "span", "event-create": "span", "score-create": "score",
    "agent-create": "span", "tool-create": "span", "chain-create": "span", "retriever-create": "span", "evaluator-create": "span", "embedding-create": "span", "guardrail-create": "span",
    "observation-create": "span", "observation-update": "span", "sdk-log": "log", "dataset-run-item-create": "run item",
}


def parse_events(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Events of JSON lines, and the lines that are none (with the reason): a bad line never fails its batch."""
    schema = EVENT_SCHEMA + ", _corrupt string"
    rows = lines.select(F.col(column).alias("line"), F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    reason = (F.when(F.col("e").isNull() | F.col("e._corrupt").isNotNull(), "not JSON").when(F.col("e.id").isNull(), "no id").when(~F.coalesce(F.col("e.type").isin(list(KINDS)), F.lit(False)), "unknown type")
              .when(F.coalesce(F.col("e.body.id"), F.col("e.body.traceId")).isNull(), "no entity").when(F.col("e.timestamp").isNull(), "no timestamp"))
    rows = rows.withColumn("reason", reason)
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), F.col("type"))
    return rows.where("reason is null").select("e.*").drop("_corrupt").withColumn("kind", kind), rows.where("reason is not null").select("line", "reason")


def scores_of(events: DataFrame) -> DataFrame:
    """The scores of score events: NUMERIC and BOOLEAN ones have a number, CATEGORICAL and BOOLEAN ones a string. A type that is not said follows
    from the value: a number makes a numeric score, anything else a categorical one. A value that its type does not allow gives no score."""
    b, number = F.col("body"), F.expr("try_cast(body.value AS double)")
    kind = F.coalesce(F.upper(b["dataType"]), F.when(number.isNotNull(), "NUMERIC").otherwise("CATEGORICAL"))
    truth = F.when(number.isin(0.0, 1.0), number).when(F.lower(b["value"]).isin("true", "false"), (F.lower(b["value"]) == "true").cast("double"))
    rows = events.where("kind = 'score'").select(
        F.coalesce(b["id"], F.col("id")).alias("id"), b["projectId"].alias("project_id"), b["traceId"].alias("trace_id"), b["observationId"].alias("observation_id"), b["sessionId"].alias("session_id"), b["datasetRunId"].alias("run_id"),
        b["name"].alias("name"), F.coalesce(F.upper(b["source"]), F.lit("API")).alias("source"), kind.alias("data_type"),
        F.when(kind == "NUMERIC", number).when(kind == "BOOLEAN", truth).alias("value"),
        F.when(kind == "CATEGORICAL", F.coalesce(b["stringValue"], b["value"])).when(kind == "BOOLEAN", F.when(truth == 1, "True").when(truth == 0, "False")).alias("string_value"),
        b["comment"].alias("comment"), b["configId"].alias("config_id"), b["queueId"].alias("queue_id"), F.coalesce(b["environment"], F.lit("default")).alias("environment"), F.col("timestamp"))
    return rows.where("value is not null or (data_type = 'CATEGORICAL' and string_value is not null)")


def shard_of(project: str | Column, entity: str | Column, shards: int) -> Column:
    """The queue shard of an entity's events: those of one entity go to one shard, whatever else arrives."""
    return F.pmod(F.xxhash64(F.concat_ws("-", project, entity)), F.lit(shards)).cast("int")


def with_defaults(spans: DataFrame) -> DataFrame:
    """Spans with the default level, and with a trace: one without a trace id is its own trace's root."""
    level = F.coalesce(F.when(F.col("level") != "", F.col("level")), F.lit("DEFAULT"))
    return spans.withColumns({"level": level, "trace_id": F.coalesce(F.when(F.col("trace_id") != "", F.col("trace_id")), F.col("span_id"))})


def scheduled(things: DataFrame, condition: Column, rate: float, delay_s: int, key: str = "span_id", time: str = "start_time") -> DataFrame:
    """Things that an evaluator takes on: those that its filter lets through and its sampling chooses (by a hash of the key, so a second run
    chooses alike), with the time at which they are due."""
    from spanlight.functions.scalars import sampled

    rows = things.where(F.coalesce(condition, F.lit(False)) & sampled(F.col(key).cast("string"), rate))
    return rows.withColumn("due_at", F.timestamp_add("SECOND", F.lit(delay_s), F.col(time)))


def is_create(kind: str | Column) -> Column:
    return (F.col(kind) if isinstance(kind, str) else kind).endswith("-create")


def merged(records: DataFrame, keys: Iterable[str], order: Iterable[str] = ("rank", "timestamp", "seq"), immutable: Iterable[str] = IMMUTABLE, tags: str = "tags", metadata: str = "metadata") -> DataFrame:
    """One record a key. ``records`` have, besides their columns, ``set``: the names of the columns that each sets, and the columns of ``order``."""
    keys, order = list(keys), list(order)
    values = [c for c in records.columns if c not in (*keys, *order, "set")]
    kinds = dict(records.dtypes)
    out = []
    for c in values:
        given = F.array_contains("set", c)
        if kinds[c].startswith(("map", "array")):
            given = given & F.col(c).isNotNull() & (F.size(c) > 0)
        if c == metadata or c == tags:
            out.append(F.array_sort(F.collect_list(F.when(given, F.struct(*order, F.to_json(c).alias("v") if c == metadata else F.col(c).alias("v"))))).alias(c))
            continue
        value = F.to_json(c) if kinds[c].startswith("map") else F.col(c)
        pick = F.min if c in immutable else F.max
        out.append(pick(F.when(given, F.struct(*order, value.alias("v"))))["v"].alias(c))
    rows = records.groupBy(*keys).agg(*out)
    for c in values:
        if c == tags:
            rows = rows.withColumn(c, F.array_sort(F.array_distinct(F.flatten(F.transform(c, lambda x: x["v"])))))
        elif c == metadata:  # later entries win
            maps = F.transform(c, lambda x: F.from_json(x["v"], "map<string, string>"))
            rows = rows.withColumn(c, F.aggregate(maps, F.from_json(F.lit("{}"), "map<string, string>"), lambda a, m: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(m, k)), m)))
        elif kinds[c].startswith("map"):
            rows = rows.withColumn(c, F.from_json(c, kinds[c]))
    if "start_time" in values and "end_time" in values:
        rows = rows.withColumn("end_time", F.when(F.col("end_time") < F.col("start_time"), F.col("start_time")).otherwise(F.col("end_time")))
    return rows.select(*keys, *values)


def last_truthy(c: str, *order: str) -> Column:
    """The newest value that is neither NULL nor blank."""
    return F.max(F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct(*order, F.col(c).alias("v"))))["v"]


def clean_usage(usage: Column) -> Column:
    """Negative counts dropped, and a total added if there is none."""
    kept = F.map_filter(usage, lambda k, v: v.isNotNull() & (v >= 0))
    total = F.aggregate(F.map_values(kept), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return F.when(F.size(kept) == 0, kept).when(F.map_contains_key(kept, F.lit("total")), kept).otherwise(F.map_concat(kept, F.create_map(F.lit("total"), total)))


def token_count(text: str | Column) -> Column:
    """Blank-separated words: the stand-in where no tokenizer is configured."""
    c = F.col(text) if isinstance(text, str) else text
    return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != "")).cast("bigint")


#: Models whose patterns are sent to every task at once.
MODELS_A_BLOCK = 10_000


def match_models(spans: DataFrame, models: DataFrame, block: int = MODELS_A_BLOCK) -> DataFrame:
    """Each span's model: a pattern that its model name matches; the project's own models first, then the newest. Model names are few
    beside spans, so the patterns are tried on the distinct (project, name) pairs only; ``block`` patterns, which are counted, at a time."""
    names = spans.select("project_id", "provided_model_name").where("provided_model_name is not null").distinct()
    listed = models.withColumnRenamed("project_id", "model_project")
    blocks = max(1, -(-models.count() // block))
    if blocks > 1:
        names, listed = cut(names), cut(listed.withColumn("_block", F.pmod(F.xxhash64("model_id"), F.lit(blocks))))
    fits = "(model_project is null or model_project = project_id) and provided_model_name rlike match_pattern"
    tried = None
    for i in range(blocks):
        part = names.join(F.broadcast(listed.where(f"_block = {i}").drop("_block") if blocks > 1 else listed), F.expr(fits))
        tried = part if tried is None else tried.unionByName(part)
    w = Window.partitionBy("project_id", "provided_model_name").orderBy(F.col("model_project").asc_nulls_last(), F.col("start_date").desc_nulls_last(), "model_id")
    found = tried.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("project_id", "provided_model_name", "model_id")
    return spans.join(found, ["project_id", "provided_model_name"], "left")


def match_tiers(spans: DataFrame, tiers: DataFrame) -> DataFrame:
    """Each span's pricing tier: the first by priority all of whose conditions hold (the sum of usage keys that match a pattern, over or
    under a threshold); the default tier otherwise. Tiers are broadcast while they are few (they are counted)."""
    listed = tiers.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("priority", "tier_id", "is_default", "conditions"))).alias("tiers"))
    rows = spans.join(sized(listed), "model_id", "left")
    hold = """filter(tiers, t -> NOT t.is_default AND forall(t.conditions, c ->
        CASE c.op WHEN '>' THEN aggregate(map_values(map_filter(usage_details, (k, v) -> k rlike c.pattern)), 0L, (a, v) -> a + v) > c.value
                  WHEN '>=' THEN aggregate(map_values(map_filter(usage_details, (k, v) -> k rlike c.pattern)), 0L, (a, v) -> a + v) >= c.value
                  WHEN '<' THEN aggregate(map_values(map_filter(usage_details, (k, v) -> k rlike c.pattern)), 0L, (a, v) -> a + v) < c.value
                  ELSE aggregate(map_values(map_filter(usage_details, (k, v) -> k rlike c.pattern)), 0L, (a, v) -> a + v) <= c.value END))"""
    return rows.withColumn("tier_id", F.coalesce(F.expr(f"get({hold}, 0).tier_id"), F.expr("get(filter(tiers, t -> t.is_default), 0).tier_id"))).drop("tiers")


def priced(spans: DataFrame, prices: DataFrame) -> DataFrame:
    """Costs of spans: given ones win (with a total over input and output if there is none), else price times units by key, and their sum."""
    table = prices.groupBy("tier_id").agg(F.map_from_entries(F.collect_list(F.struct("usage_type", F.col("price").cast("decimal(18, 12)")))).alias("_prices"))
    rows = spans.join(sized(table), "tier_id", "left")
    zero = "cast(0 AS decimal(38, 12))"
    computed = F.expr("transform_values(map_filter(usage_details, (k, v) -> _prices[k] IS NOT NULL AND k <> 'total'), (k, v) -> cast(v * _prices[k] AS decimal(38, 12)))")
    rows = rows.withColumn("_cost", F.when(F.coalesce(F.size("cost_details"), F.lit(0)) > 0, F.expr("transform_values(cost_details, (k, v) -> cast(v AS decimal(38, 12)))")).when(F.col("_prices").isNotNull(), computed))
    total = F.expr(f"coalesce(_cost['total'], aggregate(map_values(_cost), {zero}, (a, v) -> cast(a + v AS decimal(38, 12))))")
    return rows.drop("cost_details", "total_cost", "_prices").withColumn("total_cost", F.when(F.size("_cost") > 0, total)).withColumn(
        "cost_details", F.when(F.size("_cost") > 0, F.map_concat(F.map_filter("_cost", lambda k, v: k != "total"), F.create_map(F.lit("total"), F.col("total_cost"))))).drop("_cost")


def flat_metadata(c: str | Column) -> Column:
    """Entries of a JSON object as dotted paths, two levels deep; deeper values stay JSON text."""
    c = F.col(c) if isinstance(c, str) else c
    top = F.map_entries(F.from_json(c, "map<string, string>"))
    inner = F.transform(top, lambda e: F.coalesce(
        F.transform(F.map_entries(F.when(e["value"].startswith("{"), F.from_json(e["value"], "map<string, string>"))), lambda x: F.struct(F.concat(e["key"], F.lit("."), x["key"]).alias("key"), x["value"].alias("value"))), F.array(F.struct(e["key"].alias("key"), e["value"].alias("value")))))
    return F.map_from_entries(F.flatten(inner))


def tool_calls(output: str | Column) -> Column:
    """Names of the tools that a model's JSON output calls, in the common shapes of a message."""
    c = F.col(output) if isinstance(output, str) else output
    names = "array<struct<name:string,function:struct<name:string>>>"
    got = lambda p: F.from_json(F.get_json_object(c, p), names)
    return F.transform(F.coalesce(got("$.tool_calls"), got("$.choices[0].message.tool_calls"), got("$.message.tool_calls"), F.array().cast(names)), lambda x: F.coalesce(x["function"]["name"], x["name"]))


def observation_type(name: str = "name", model: str = "model", attributes: str | None = None) -> Column:
    """The type of a span: as its attributes say, else a generation if it has a model, else a span."""
    said = F.upper(F.col(attributes)["observation.type"]) if attributes else F.lit(None).cast("string")
    known = ("SPAN", "EVENT", "GENERATION", "AGENT", "TOOL", "CHAIN", "RETRIEVER", "EVALUATOR", "EMBEDDING", "GUARDRAIL")
    return F.when(said.isin(*known), said).when(F.col(model).isNotNull(), "GENERATION").otherwise("SPAN")


def upsert(spark, rows: DataFrame, path: str, keys: Iterable[str], partition: str, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Merge rows into a table partitioned by a day column: only the touched partitions are read and rewritten. The start time is immutable,
    so a late event finds its record in the partition where it was first written. Rows without a day take that of their key, from the
    batch or from what is stored (its key and day columns are looked up); where neither knows one, they wait in the partition without
    a day, and move when a day comes."""
    from spanlight.sources.sinks import exists, replace_partitions

    keys = [k for k in keys if k != partition]
    rows, day = cut(rows), F.col(partition)
    if rows.isEmpty():
        return
    if exists(spark, path):
        table = spark.read.parquet(path)
        table = table.withColumn(partition, day.cast(rows.schema[partition].dataType))
        homeless = rows.where(day.isNull()).select(*keys).distinct()
        homes = table.where(day.isNotNull()).join(homeless, keys, "left_semi").select(partition)
        days = [r[0] for r in rows.where(day.isNotNull()).select(partition).unionByName(homes).distinct().collect()]  # the days of a batch, not its rows
        old = table.where(day.isin(days) | day.isNull() if days else day.isNull())
        rows = old.unionByName(rows, allowMissingColumns=True)
    found = rows.where(day.isNotNull()).join(rows.where(day.isNull()).select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.min(partition).alias("_day"))
    rows = rows.join(found, keys, "left").withColumn(partition, F.coalesce(day, "_day")).drop("_day")
    replace_partitions(merge(rows), path, partition, [None])


def stream(events: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame], keys: Iterable[str], partition: str, merge: Callable[[DataFrame], DataFrame], once: bool = True) -> StreamingQuery:
    """A streaming upsert: each micro-batch is prepared, merged by key with what is stored, and written. No watermark: late events merge by key."""
    def batch(df: DataFrame, number: int) -> None:
        upsert(df.sparkSession, prepare(df), path, keys, partition, merge)

    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def tumbling(events: DataFrame, time: str, size: str, late: str, *by: str) -> DataFrame:
    """Counts by tumbling event-time windows, with state bounded by a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count(F.lit(1)).alias("n"))
