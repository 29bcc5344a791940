"""The semantic layer: four views with their dimensions, measures and relations.

An entity of a view is one row of its base table (tables are upserted by key), so measures are row expressions and a
metrics query needs one aggregation of the base. Measures and dimensions of a relation are aggregated to the entity's key
first and then joined, so that two relations never multiply each other's rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlight.functions.scalars import array_size, blank_to_null, key_sum, millis, ratio, seconds


@dataclass(frozen=True)
class Dimension:
    """A column to group by. ``explode``: the array or map that makes rows of it; ``relation``: where it comes from; ``empty_is_null``: a blank
    counts as missing when it is grouped by, while filters see what is stored."""

    expr: Column | str
    relation: str | None = None
    explode: str | None = None
    array: bool = False
    empty_is_null: bool = False


@dataclass(frozen=True)
class Measure:
    """A number of an entity. For a relation, ``expr`` aggregates the entity's related rows; ``needs`` is a dimension it comes with."""

    expr: object
    relation: str | None = None
    numeric: bool = True
    needs: str | None = None
    zero: bool = False


@dataclass(frozen=True)
class Relation:
    """Related rows: their frame, the key columns (base column, related column) and their time column."""

    frame: str
    keys: tuple[tuple[str, str], ...]
    time: str
    roots_only: bool = False


@dataclass(frozen=True)
class View:
    frame: str
    time: str
    dimensions: dict[str, Dimension]
    measures: dict[str, Measure]
    relations: dict[str, Relation] = field(default_factory=dict)
    segment: object = None


#: Dimensions whose blanks are shown as missing.
EMPTY_IS_NULL = ("userId", "sessionId", "release", "version", "environment", "traceRelease", "providedModelName")


def _plain(**names: str) -> dict[str, Dimension]:
    return {name: Dimension(column, empty_is_null=name in EMPTY_IS_NULL) for name, column in names.items()}


def build_views() -> dict[str, View]:
    """The registry; a function, as columns need a running session."""
    c = F.col
    traces = View(
        "spans", "start_time",
        {
            **_plain(id="trace_id", name="name", userId="user_id", sessionId="session_id", release="release", version="version", environment="environment"),
            "tags": Dimension("tags", array=True), "timestampMonth": Dimension(F.date_format("start_time", "yyyy-MM")),
            "observationName": Dimension("name", "observations"), "scoreName": Dimension("name", "scores"),
        },
        {
            "count": Measure(F.lit(1)),
            "observationsCount": Measure(lambda: F.count("span_id"), "observations", zero=True), "scoresCount": Measure(lambda: F.count("id"), "scores", zero=True),
            "latency": Measure(lambda: F.timestamp_diff("MILLISECOND", F.min("start_time"), F.max("end_time")), "observations"),
            "totalTokens": Measure(lambda: F.sum(c("usage_details")["total"]), "observations"), "totalCost": Measure(lambda: F.sum("total_cost"), "observations"),
            "uniqueUserIds": Measure(blank_to_null("user_id"), numeric=False), "uniqueSessionIds": Measure(blank_to_null("session_id"), numeric=False),
        },
        {
            "observations": Relation("spans", (("project_id", "project_id"), ("trace_id", "trace_id")), "start_time"),
            "scores": Relation("scores", (("trace_id", "trace_id"),), "timestamp"),
        },
        c("parent_span_id") == "",
    )
    observations = View(
        "spans", "start_time",
        {
            **_plain(id="span_id", traceId="trace_id", environment="environment", parentObservationId="parent_span_id", type="type", name="name", level="level", version="version",
                     providedModelName="provided_model_name", promptName="prompt_name", promptVersion="prompt_version", userId="user_id", sessionId="session_id", traceRelease="release"),
            "tags": Dimension("tags", array=True), "traceName": Dimension("name", "traces"), "traceVersion": Dimension("version", "traces"), "scoreName": Dimension("name", "scores"),
            "startTimeMonth": Dimension(F.date_format("start_time", "yyyy-MM")),
            "toolNames": Dimension(F.map_keys("tool_definitions"), explode="array"), "calledToolNames": Dimension("tool_call_names", explode="array"),
            "costType": Dimension("cost_details", explode="map"), "usageType": Dimension("usage_details", explode="map"),
        },
        {
            "count": Measure(F.lit(1)), "latency": Measure(millis("start_time", "end_time")), "streamingLatency": Measure(millis("completion_start_time", "end_time")),
            "inputTokens": Measure(key_sum("usage_details", "input")), "outputTokens": Measure(key_sum("usage_details", "output")), "totalTokens": Measure(c("usage_details")["total"]),
            "outputTokensPerSecond": Measure(ratio(key_sum("usage_details", "output").cast("double"), seconds("start_time", "end_time"))),
            "tokensPerSecond": Measure(ratio(c("usage_details")["total"].cast("double"), seconds("start_time", "end_time"))),
            "inputCost": Measure(key_sum("cost_details", "input")), "outputCost": Measure(key_sum("cost_details", "output")), "totalCost": Measure(c("total_cost")),
            "timeToFirstToken": Measure(millis("start_time", "completion_start_time")), "countScores": Measure(lambda: F.count("id"), "scores", zero=True),
            "toolDefinitions": Measure(array_size("tool_definitions")), "toolCalls": Measure(array_size("tool_call_names")),
            "costByType": Measure(c("_costType"), needs="costType"), "usageByType": Measure(c("_usageType"), needs="usageType"),
        },
        {
            "traces": Relation("spans", (("project_id", "project_id"), ("trace_id", "trace_id")), "start_time", roots_only=True),
            "scores": Relation("scores", (("span_id", "observation_id"),), "timestamp"),
        },
    )
    score_dimensions = {
        **_plain(id="id", environment="environment", name="name", source="source", dataType="data_type", traceId="trace_id", observationId="observation_id"),
        **{name: Dimension(column, "traces") for name, column in {"traceName": "name", "userId": "user_id", "sessionId": "session_id", "traceRelease": "release", "traceVersion": "version"}.items()},
        "tags": Dimension("tags", "traces", array=True),
        **{name: Dimension(column, "observations") for name, column in {"observationName": "name", "observationModelName": "provided_model_name", "observationPromptName": "prompt_name", "observationPromptVersion": "prompt_version"}.items()},
    }
    score_relations = {
        "traces": Relation("spans", (("trace_id", "trace_id"),), "start_time", roots_only=True),
        "observations": Relation("spans", (("observation_id", "span_id"),), "start_time"),
    }
    numeric = View("scores", "timestamp", score_dimensions, {"count": Measure(F.lit(1)), "value": Measure(c("value"))}, score_relations, F.instr("data_type", "CATEGORICAL") == 0)
    categorical = View("scores", "timestamp", {**score_dimensions, "stringValue": Dimension("string_value")}, {"count": Measure(F.lit(1))}, score_relations, c("data_type") == "CATEGORICAL")
    return {"traces": traces, "observations": observations, "scores-numeric": numeric, "scores-categorical": categorical}
