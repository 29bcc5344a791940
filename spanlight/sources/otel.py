"""Reading OpenTelemetry trace exports (JSON) into spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lists within lists that attribute values are read to; deeper ones stay JSON text as sent.
VALUE_DEPTH = 4


def _value_schema(depth: int) -> str:
    inner = _value_schema(depth - 1) if depth else "string"
    return f"struct<stringValue: string, intValue: string, doubleValue: double, boolValue: boolean, bytesValue: string, arrayValue: struct<values: array<{inner}>>, kvlistValue: struct<values: array<struct<key: string, value: {inner}>>>>"


_ATTRIBUTES = f"array<struct<key: string, value: {_value_schema(VALUE_DEPTH)}>>"
SCHEMA = f"""resourceSpans array<struct<resource: struct<attributes: {_ATTRIBUTES}>, scopeSpans: array<struct<scope: struct<name: string, version: string, attributes: {_ATTRIBUTES}>, spans: array<struct<
 traceId: string, spanId: string, parentSpanId: string, name: string, startTimeUnixNano: string, endTimeUnixNano: string, status: struct<code: int, message: string>, attributes: {_ATTRIBUTES},
 events: array<struct<name: string, timeUnixNano: string, attributes: {_ATTRIBUTES}>>, links: array<struct<traceId: string, spanId: string, attributes: {_ATTRIBUTES}>>>>>>>>"""

#: Span kinds and operation names of the common instrumentations, by the observation type that they mean.
KIND_TYPES = {
    "LLM": "GENERATION", "GENERATION": "GENERATION", "SPAN": "SPAN", "EVENT": "EVENT", "AGENT": "AGENT", "TOOL": "TOOL", "CHAIN": "CHAIN", "WORKFLOW": "CHAIN", "TASK": "SPAN", "RETRIEVER": "RETRIEVER",
    "EVALUATOR": "EVALUATOR", "EMBEDDING": "EMBEDDING", "GUARDRAIL": "GUARDRAIL", "RERANKER": "RETRIEVER",
}
OPERATION_TYPES = {
    "chat": "GENERATION", "completion": "GENERATION", "text_completion": "GENERATION", "generate_content": "GENERATION", "generate": "GENERATION", "embeddings": "EMBEDDING", "invoke_agent": "AGENT", "create_agent": "AGENT",
    "execute_tool": "TOOL",
}
SDK_OPERATION_TYPES = {
    "ai.generateText.doGenerate": "GENERATION", "ai.streamText.doStream": "GENERATION", "ai.generateObject.doGenerate": "GENERATION", "ai.streamObject.doStream": "GENERATION", "ai.embed.doEmbed": "EMBEDDING",
    "ai.embedMany.doEmbed": "EMBEDDING", "ai.toolCall": "TOOL",
}
#: Attributes that name a kind, in the order in which they count.
KIND_KEYS = ("openinference.span.kind", "traceloop.span.kind")
MODEL_KEYS = ("gen_ai.response.model", "gen_ai.request.model", "llm.response.model", "llm.model_name", "llm.request.model", "ai.model.id", "model")
#: Usage attributes of the common instrumentations, by usage type.
USAGE_KEYS = {
    "input": ("gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens", "llm.token_count.prompt", "llm.usage.prompt_tokens", "ai.usage.promptTokens", "ai.usage.inputTokens"),
    "output": ("gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens", "llm.token_count.completion", "llm.usage.completion_tokens", "ai.usage.completionTokens", "ai.usage.outputTokens"),
    "total": ("gen_ai.usage.total_tokens", "llm.token_count.total", "llm.usage.total_tokens", "ai.usage.totalTokens"),
    "cache_read_input": ("gen_ai.usage.cache_read_input_tokens", "gen_ai.usage.cached_input_tokens"),
}
COST_KEYS = {"total": ("gen_ai.usage.cost", "llm.cost.total"), "input": ("llm.cost.prompt",), "output": ("llm.cost.completion",)}


def _quoted(c: Column) -> Column:
    one = F.to_json(F.array(c))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def _json(v: Column, depth: int) -> Column:
    """An attribute's value as JSON."""
    inner = (lambda x: _json(x, depth - 1)) if depth else (lambda x: x)
    listed = F.concat(F.lit("["), F.array_join(F.transform(v["arrayValue"]["values"], inner), ","), F.lit("]"))
    named = F.concat(F.lit("{"), F.array_join(F.transform(v["kvlistValue"]["values"], lambda e: F.concat(_quoted(e["key"]), F.lit(":"), F.coalesce(inner(e["value"]), F.lit("null")))), ","), F.lit("}"))
    return F.coalesce(F.when(F.coalesce(v["stringValue"], v["bytesValue"]).isNotNull(), _quoted(F.coalesce(v["stringValue"], v["bytesValue"]))),
                      v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"), listed, named)


def attributes(c: str | Column) -> Column:
    """A list of typed attributes as a map of strings, lists and objects as JSON; of equal keys the last one counts."""
    c = F.col(c) if isinstance(c, str) else c
    entries = F.transform(c, lambda a: F.struct(a["key"].alias("key"), F.coalesce(a["value"]["stringValue"], a["value"]["bytesValue"], _json(a["value"], VALUE_DEPTH)).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string, string>"))


def nano_time(c: str | Column) -> Column:
    """Nanoseconds since the epoch, as text, to microseconds."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_micros((c.cast("decimal(20, 0)") / 1000).cast("bigint"))


def _looked_up(table: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), c)


def observation_type(attr: Column, model: Column) -> Column:
    """A span's type: what an attribute that ends in observation.type says, else its kind, its operation, or that it names a model."""
    said = F.get(F.filter(F.map_entries(attr), lambda e: e["key"].endswith("observation.type")), F.lit(0))["value"]
    kinds = [_looked_up(KIND_TYPES, F.upper(x)) for x in (said, *(attr[k] for k in KIND_KEYS))]
    return F.coalesce(*kinds, _looked_up(OPERATION_TYPES, attr["gen_ai.operation.name"]), _looked_up(SDK_OPERATION_TYPES, F.substring_index(attr["ai.operationId"], " ", 1)), F.when(model.isNotNull(), "GENERATION"), F.lit("SPAN"))


def _numbers(attr: Column, keys: dict[str, tuple[str, ...]], kind: str) -> Column:
    """A map of the keys that some attribute has a number for."""
    pairs = (x for name, listed in keys.items() for x in (F.lit(name), F.coalesce(*(attr[k] for k in listed)).try_cast(kind)))
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def read_spans(lines: DataFrame, column: str = "value") -> DataFrame:
    """Spans of export requests, one JSON document a row. Metadata has the attributes of resource, scope and span, the span's counting most."""
    rows = lines.select(F.from_json(column, SCHEMA).alias("r")).select(F.explode("r.resourceSpans").alias("r"))
    rows = rows.select(attributes("r.resource.attributes").alias("resource"), F.explode("r.scopeSpans").alias("s")).select("resource", F.col("s.scope.name").alias("scope"), F.col("s.scope.version").alias("scope_version"), attributes("s.scope.attributes").alias("scope_attr"), F.explode("s.spans").alias("x"))
    rows = rows.select("resource", "scope", "scope_version", "scope_attr", "x.*", attributes("x.attributes").alias("attr"))
    a = F.col("attr")
    get = lambda *names: F.coalesce(*(a[n] for n in names))
    model = get(*MODEL_KEYS)
    over = lambda low, high: F.map_concat(F.map_filter(low, lambda k, v: ~F.map_contains_key(high, k)), high)
    events = F.transform("events", lambda e: F.struct(e["name"].alias("name"), nano_time(e["timeUnixNano"]).alias("time"), attributes(e["attributes"]).alias("attributes")))
    links = F.transform("links", lambda e: F.struct(e["traceId"].alias("trace_id"), e["spanId"].alias("span_id")))
    return rows.select(
        F.col("traceId").alias("trace_id"), F.col("spanId").alias("span_id"), F.coalesce("parentSpanId", F.lit("")).alias("parent_span_id"), "name", "scope", "scope_version", nano_time("startTimeUnixNano").alias("start_time"), nano_time("endTimeUnixNano").alias("end_time"),
        F.when(F.col("status.code") == 2, "ERROR").otherwise("DEFAULT").alias("level"), F.col("status.message").alias("status_message"), observation_type(a, model).alias("type"), model.alias("provided_model_name"),
        get("user.id", "enduser.id").alias("user_id"), get("session.id", "gen_ai.conversation.id").alias("session_id"), F.coalesce(a["deployment.environment"], F.col("resource")["deployment.environment.name"], F.col("resource")["deployment.environment"], F.lit("default")).alias("environment"),
        F.col("resource")["service.name"].alias("service"), get("input.value", "gen_ai.prompt", "ai.prompt").alias("input"), get("output.value", "gen_ai.completion", "ai.response.text").alias("output"),
        _numbers(a, USAGE_KEYS, "bigint").alias("usage_details"), _numbers(a, COST_KEYS, "decimal(38, 12)").alias("cost_details"), reduce(over, [F.col("resource"), F.col("scope_attr"), a]).alias("metadata"), events.alias("events"), links.alias("links"))
