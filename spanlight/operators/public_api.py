"""What a public interface adds: filters from request parameters, field groups, and raw conditions of trusted callers."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters

#: Field groups of a span; ``core`` is always there.
FIELD_GROUPS: dict[str, tuple[str, ...]] = {
    "core": ("project_id", "trace_id", "span_id", "parent_span_id", "type", "start_time", "end_time"),
    "basic": ("name", "level", "environment", "version", "user_id", "session_id"),
    "time": ("completion_start_time", "event_ts"),
    "model": ("provided_model_name",),
    "usage": ("usage_details", "cost_details", "total_cost"),
    "prompt": ("prompt_name", "prompt_version"),
    "metadata": ("metadata",),
    "trace": ("trace_name", "tags", "release"),
}


def field_groups(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Only the columns of the groups asked for; an unknown group is an error, a column that the frame lacks is not."""
    unknown = [g for g in groups if g not in FIELD_GROUPS]
    if unknown:
        raise filters.FilterError(f"unknown field groups {unknown}")
    wanted = [c for g in dict.fromkeys(["core", *groups]) for c in FIELD_GROUPS[g]]
    return df.select(*(c for c in wanted if c in df.columns))


def from_parameters(parameters: Mapping[str, object], simple: Mapping[str, tuple[str, str, str]]) -> list[dict]:
    """Filters of a request. ``simple`` maps a parameter to (column, type, operator); the parameter ``filter`` is a JSON list of whole filters, which
    take the place of all simple ones on their columns. Lists of a parameter are lists of options; absent and empty ones filter nothing."""
    advanced = parameters.get("filter") or []
    advanced = json.loads(advanced) if isinstance(advanced, str) else list(advanced)
    if not isinstance(advanced, list) or not all(isinstance(f, dict) and "column" in f for f in advanced):
        raise filters.FilterError("filter must be a list of filters")
    taken = {f["column"] for f in advanced}
    out = []
    for name, value in parameters.items():
        if name == "filter" or name not in simple or value in (None, "", []):
            continue
        column, kind, operator = simple[name]
        if column not in taken:
            listed = kind in ("stringOptions", "arrayOptions", "categoryOptions")
            out.append({"type": kind, "column": column, "operator": operator, "value": list(value) if listed and not isinstance(value, str) else [value] if listed else value})
    return out + advanced


def where(df: DataFrame, parameters: Mapping[str, object], simple: Mapping[str, tuple[str, str, str]], columns: Mapping[str, Column | str]) -> DataFrame:
    """Rows that a request's parameters let through."""
    return df.where(filters.all_of(from_parameters(parameters, simple), columns))


def raw(df: DataFrame, condition: str | None, trusted: bool = False) -> DataFrame:
    """Rows for which a SQL condition holds, which only trusted callers may give. It is one expression over the frame's columns: no subquery and no
    second statement."""
    if not condition:
        return df
    if not trusted:
        raise filters.FilterError("raw conditions are for trusted callers only")
    if ";" in condition or "select" in condition.lower().split():
        raise filters.FilterError("a raw condition is one expression")
    return df.where(F.expr(f"({condition})"))
