"""The filter algebra: typed filters on named columns become one boolean Column.

A filter is a dict: type, column, operator, value and, for object types, key. Lists are ANDed. Column names go
through a whitelist. SQL's NULL rules hold (``does not contain`` drops NULL) unless ``null_as_empty`` is set, which
is how records outside a table are judged.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<>": lambda c, v: c != v,
    ">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v,
}
TEXT: dict[str, Callable[[Column, str], Column]] = {
    "=": lambda c, v: c == v, "contains": lambda c, v: F.instr(c, v) > 0, "does not contain": lambda c, v: F.instr(c, v) == 0,
    "starts with": lambda c, v: c.startswith(v), "ends with": lambda c, v: c.endswith(v),
}
#: Operators of each filter type.
OPERATORS = {
    "string": tuple(TEXT), "number": ("=", ">", "<", ">=", "<=", "!="), "datetime": (">", "<", ">=", "<="), "boolean": ("=", "<>"), "null": ("is null", "is not null"),
    "stringOptions": ("any of", "none of"), "arrayOptions": ("any of", "none of", "all of"), "categoryOptions": ("any of", "none of"), "stringObject": tuple(TEXT),
    "numberObject": ("=", ">", "<", ">=", "<=", "!="), "positionInTrace": ("=",),
}


class FilterError(ValueError):
    """A filter names an unknown column or an operator its type lacks."""


def checked(f: Mapping) -> None:
    if f["type"] not in OPERATORS:
        raise FilterError(f"unknown filter type {f['type']!r}")
    if f.get("operator", "=") not in OPERATORS[f["type"]]:
        raise FilterError(f"{f['type']} has no operator {f.get('operator')!r}")
    if f["type"] in ("stringObject", "numberObject", "categoryOptions") and not f.get("key"):
        raise FilterError(f"{f['type']} needs a key")


def resolved(columns: Mapping[str, Column | str], name: str) -> Column:
    """A whitelisted column; an unknown name that ends in Name falls back to ``name``."""
    if name not in columns and name.endswith("Name") and "name" in columns:
        name = "name"
    if name not in columns:
        raise FilterError(f"unknown column {name!r}")
    found = columns[name]
    return F.col(found) if isinstance(found, str) else found


def _list(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def condition(f: Mapping, columns: Mapping[str, Column | str], null_as_empty: bool = False) -> Column:
    """One filter as a Column."""
    checked(f)
    kind, op, value = f["type"], f.get("operator", "="), f.get("value")
    c = resolved(columns, f["column"])
    if kind == "string":
        return TEXT[op](F.coalesce(c, F.lit("")) if null_as_empty else c, value)
    if kind == "number":
        return COMPARE[op](c, F.lit(value))
    if kind == "datetime":
        at = value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(value)
        if at.tzinfo:
            at = at.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return COMPARE[op](c, F.lit(at.isoformat(sep=" ", timespec="microseconds")).cast("timestamp_ntz"))
    if kind == "boolean":
        return COMPARE[op](c, F.lit(bool(value)))
    if kind == "null":
        return c.isNull() if op == "is null" else c.isNotNull()
    if kind == "stringOptions":
        if not value:
            return F.lit(op == "none of")
        c = F.coalesce(c, F.lit("")) if null_as_empty else c
        return c.isin(list(value)) if op == "any of" else ~c.isin(list(value))
    if kind == "arrayOptions":
        if not value:
            return F.lit(op != "any of")
        if op == "all of":
            return reduce(Column.__and__, (F.array_contains(c, v) for v in value))
        found = F.arrays_overlap(c, _list(value))
        return found if op == "any of" else ~found
    if kind == "categoryOptions":
        if not value:
            return F.lit(op == "none of")
        found = F.arrays_overlap(c, _list(f"{f['key']}:{v}" for v in value))
        return found if op == "any of" else ~found
    if kind == "stringObject":
        entry = c[f["key"]]
        return TEXT[op](F.coalesce(entry, F.lit("")) if null_as_empty else entry, value)
    if kind == "numberObject":
        return F.exists(c, lambda x: (x["name"] == f["key"]) & COMPARE[op](x["value"].cast("decimal(20, 6)"), F.lit(value)))
    raise FilterError("positionInTrace is applied by position_in_trace")


def all_of(filters: Iterable[Mapping], columns: Mapping[str, Column | str], null_as_empty: bool = False) -> Column:
    parts = [condition(f, columns, null_as_empty) for f in filters if f["type"] != "positionInTrace"]
    return reduce(Column.__and__, parts, F.lit(True))


def position_in_trace(spans: DataFrame, mode: str, n: int = 1, order: tuple[str, ...] = ("start_time", "span_id")) -> DataFrame:
    """Rows at a place in their trace: root, last, nthFromStart or nthFromEnd."""
    if mode == "root":
        return spans.where(F.coalesce(F.col("parent_span_id"), F.lit("")) == "")
    if mode not in ("last", "nthFromStart", "nthFromEnd"):
        raise FilterError(f"unknown position {mode!r}")
    back = mode != "nthFromStart"
    n = 1 if mode == "last" else n
    if n == 1:  # an extreme needs no window
        pick = (F.max if back else F.min)(F.struct(*order))
        ends = spans.groupBy("project_id", "trace_id").agg(pick.alias("x")).select("project_id", "trace_id", *(F.col(f"x.{c}").alias(c) for c in order))
        return spans.join(ends, ["project_id", "trace_id", *order], "left_semi")
    by = [F.col(c).desc() if back else F.col(c).asc() for c in order]
    numbered = spans.withColumn("_place", F.row_number().over(Window.partitionBy("project_id", "trace_id").orderBy(*by)))
    return numbered.where(F.col("_place") == n).drop("_place")


def by_counts(rows: DataFrame, key: str, things: DataFrame, thing_key: str, least: int | None = None, most: int | None = None) -> DataFrame:
    """Rows whose number of attached things (comments, say) lies in a range. Zero means absent, so a range with 0 in it excludes the
    rows outside it by an anti join, and any other keeps those inside it by a semi join."""
    counts = things.groupBy(F.col(thing_key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    low, high = F.lit(True) if least is None else F.col("_n") >= least, F.lit(True) if most is None else F.col("_n") <= most
    if not least:
        return rows.join(counts.where(~(low & high)), F.col(key) == F.col("_key"), "left_anti")
    return rows.join(counts.where(low & high), F.col(key) == F.col("_key"), "left_semi")
