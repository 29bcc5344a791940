"""Declarative metrics queries compiled to DataFrames.

A query is a dict: view, dimensions, metrics (measure and aggregation), filters, timeDimension, fromTimestamp,
toTimestamp, orderBy, rowLimit and bins. The base is filtered first (time range inclusive at both ends), relations are filtered
by the same range, aggregated to the entity's key and joined, and one aggregation by dimensions and time bucket follows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.operators import filters as algebra
from spanlight.operators import timeseries
from spanlight.operators.histogram import binned
from spanlight.operators.public_api import raw

from .views import Dimension, Measure, View, build_views

PERCENTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
NUMERIC = ("sum", "avg", "count", "max", "min", *PERCENTILES, "histogram", "uniq")
OTHER = ("count", "uniq")
MAX_ROWS = 1000
#: Dimensions with so many values that a result grouped by them must be a top list.
HIGH_CARDINALITY = ("id", "traceId", "userId", "sessionId", "parentObservationId", "observationId")


class QueryError(ValueError):
    """The query asks for something that its view lacks."""


def _time(value) -> dt.datetime:
    return value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(value)


def _stamp(value) -> Column:
    return F.lit(_time(value).isoformat(sep=" ", timespec="microseconds")).cast("timestamp_ntz")


def aggregate(kind: str, c: Column, exact: bool = True) -> Column:
    """The outer aggregation of a measure. Percentiles are exact, or approximate if so asked for very large groups."""
    if kind == "sum":
        return F.coalesce(F.sum(c), F.lit(0))
    if kind in PERCENTILES:
        return F.percentile(c, F.lit(PERCENTILES[kind])) if exact else F.percentile_approx(c, PERCENTILES[kind])
    return {"avg": F.avg, "count": F.count, "max": F.max, "min": F.min, "uniq": F.count_distinct}[kind](c)


def validate(query: Mapping) -> View:
    """The query's view, if the view has all it names."""
    views = build_views()
    if query["view"] not in views:
        raise QueryError(f"unknown view {query['view']!r}")
    view = views[query["view"]]
    for d in query.get("dimensions", ()):
        if d["field"] not in view.dimensions:
            raise QueryError(f"{query['view']} has no dimension {d['field']!r}")
    if not query.get("metrics"):
        raise QueryError("a query needs a metric")
    for m in query["metrics"]:
        if m["measure"] not in view.measures:
            raise QueryError(f"{query['view']} has no measure {m['measure']!r}")
        allowed = NUMERIC if view.measures[m["measure"]].numeric else OTHER
        if m["aggregation"] not in allowed:
            raise QueryError(f"{m['measure']} cannot be aggregated by {m['aggregation']!r}")
    if not 1 <= query.get("rowLimit", MAX_ROWS) <= MAX_ROWS or not 1 <= query.get("bins", 10) <= 100:
        raise QueryError("rowLimit lies in 1..1000 and bins in 1..100")
    expanded = [d["field"] for d in query.get("dimensions", ()) if view.dimensions[d["field"]].explode == "map"]
    if len(expanded) > 1:
        raise QueryError("a query can expand one map only")
    return view


def guard_cardinality(query: Mapping) -> None:
    """Queries by a dimension of very many values must be top lists: a row limit, a descending metric first, and no time dimension."""
    if not any(d["field"] in HIGH_CARDINALITY for d in query.get("dimensions", ())):
        return
    down = [o["field"] for o in query.get("orderBy") or [] if o["direction"] == "desc"]
    names = [f"{m['aggregation']}_{m['measure']}" for m in query["metrics"]]
    if query.get("timeDimension") or not query.get("rowLimit") or not down or not set(down) <= set(names):
        raise QueryError("a dimension with very many values needs rowLimit, descending metrics in orderBy and no timeDimension")


def widget_order(chart: str, sort: Mapping | None, needs_top: bool, first: Mapping | None) -> list[dict] | None:
    """The orderBy of a dashboard's widget: a pivot table's own sorting, else the first metric descending where a top list is needed."""
    if chart == "PIVOT_TABLE" and sort:
        return [{"field": sort["column"], "direction": sort["order"].lower()}]
    if needs_top and first:
        return [{"field": f"{first['aggregation']}_{first['measure']}", "direction": "desc"}]
    return None


def default_order(query: Mapping) -> list[dict]:
    """Time ascending, else the first metric descending, else the first dimension ascending."""
    if query.get("timeDimension"):
        return [{"field": "time_dimension", "direction": "asc"}]
    if query.get("metrics") and query["metrics"][0]["aggregation"] != "histogram":
        m = query["metrics"][0]
        return [{"field": f"{m['aggregation']}_{m['measure']}", "direction": "desc"}]
    return [{"field": d["field"], "direction": "asc"} for d in query.get("dimensions", ())[:1]]


def _value(d: Dimension) -> Column:
    return F.col(d.expr) if isinstance(d.expr, str) else d.expr


def _shown(d: Dimension) -> Column:
    """A dimension to group by; filters see the raw column."""
    return F.nullif(_value(d), F.lit("")) if d.empty_is_null else _value(d)


def compile_query(query: Mapping, frames: Mapping[str, DataFrame], exact: bool = True, guard: bool = True, trusted: bool = False) -> DataFrame:
    """The DataFrame of a query over the frames ``spans`` and ``scores``. With ``guard``, dimensions of very many values are for top lists only.
    ``rawFilter`` is a SQL condition on the base's columns that a trusted caller adds."""
    view = validate(query)
    if guard:
        guard_cardinality(query)
    window = lambda column: ((F.col(column) >= _stamp(query["fromTimestamp"])) & (F.col(column) <= _stamp(query["toTimestamp"]))) if query.get("fromTimestamp") else F.lit(True)
    names = [d["field"] for d in query.get("dimensions", ())]
    for m in query["metrics"]:
        needed = view.measures[m["measure"]].needs
        if needed and needed not in names:
            names.append(needed)
    dims = {n: view.dimensions[n] for n in names}
    measures = {m["measure"]: view.measures[m["measure"]] for m in query["metrics"]}
    filters = list(query.get("filters", ()))
    of_filter = {id(f): view.dimensions.get(f["column"], Dimension("")).relation for f in filters}
    base = frames[view.frame].where(window(view.time))
    if view.segment is not None:
        base = base.where(view.segment)
    base = raw(base, query.get("rawFilter"), trusted)
    own = {n: _value(d) for n, d in view.dimensions.items() if not d.relation and not d.explode}
    own |= {"metadata": F.col("metadata"), "startTime": F.col(view.time), "timestamp": F.col(view.time)} | {n: m.expr for n, m in view.measures.items() if not m.relation and not m.needs and m.numeric}
    base = base.where(algebra.all_of([f for f in filters if not of_filter[id(f)]], own))
    for name in dict.fromkeys([x.relation for x in (*dims.values(), *measures.values()) if x.relation] + [r for r in of_filter.values() if r]):
        base = _related(base, view, name, frames, window, dims, measures, [f for f in filters if of_filter[id(f)] == name], bool(query.get("fromTimestamp")))
    for n, d in dims.items():
        if d.explode == "map":
            base = base.select("*", F.explode(_value(d)).alias(f"dim_{n}", f"_{n}"))
        elif d.explode:
            base = base.withColumn(f"dim_{n}", F.explode(_value(d)))
        elif not d.relation:
            base = base.withColumn(f"dim_{n}", _shown(d))
    keys = [F.col(f"dim_{n}").alias(n) for n in dims]
    if query.get("timeDimension"):
        size = query["timeDimension"].get("granularity", "auto")
        size = timeseries.auto_granularity(_time(query["fromTimestamp"]), _time(query["toTimestamp"])) if size == "auto" else size
        keys.insert(0, timeseries.bucket(view.time, size).alias("time_dimension"))
    number = lambda n, m: F.col(f"rel_{n}") if m.relation else m.expr
    histograms = [m["measure"] for m in query["metrics"] if m["aggregation"] == "histogram"]
    if histograms:
        rows = base.select(*keys, number(histograms[0], measures[histograms[0]]).cast("double").alias("_x"))
        return binned(rows, "_x", query.get("bins", 10), list(dims) + ["time_dimension"] * bool(query.get("timeDimension")))
    metrics = [aggregate(m["aggregation"], number(m["measure"], measures[m["measure"]]), exact).alias(f"{m['aggregation']}_{m['measure']}") for m in query["metrics"]]
    out = base.groupBy(*keys).agg(*metrics)
    known = set(out.columns)
    order = query.get("orderBy") or []
    for o in order:
        if o["field"] not in known:
            raise QueryError(f"cannot order by {o['field']!r}")
    if query.get("timeDimension") and not order and query.get("fillGaps", True):
        out = timeseries.fill_gaps(out, _time(query["fromTimestamp"]), _time(query["toTimestamp"]), size, [f"{m['aggregation']}_{m['measure']}" for m in query["metrics"]], list(dims))
    if order or query.get("rowLimit"):
        by = order or default_order(query)
        first = [F.col(o["field"]).desc_nulls_last() if o["direction"] == "desc" else F.col(o["field"]).asc_nulls_first() for o in by]
        out = out.orderBy(*first, *(F.col(n).asc() for n in dims))
    return out.limit(query["rowLimit"]) if query.get("rowLimit") else out


def _related(base: DataFrame, view: View, name: str, frames: Mapping[str, DataFrame], window, dims: Mapping[str, Dimension], measures: Mapping[str, Measure], filters: list, windowed: bool) -> DataFrame:
    """The base joined with one relation, aggregated to the base's key. A time range holds for the related rows too, which makes the
    join an inner one, as does a filter on them; without either, rows that have no related ones stay."""
    relation = view.relations[name]
    rows = frames[relation.frame].where(window(relation.time))
    if relation.roots_only:
        rows = rows.where(F.col("parent_span_id") == "")
    rows = rows.where(algebra.all_of(filters, {n: _value(d) for n, d in view.dimensions.items() if d.relation == name}))
    keys = [F.col(there).alias(f"_key_{i}") for i, (_, there) in enumerate(relation.keys)]
    found = [F.min(_shown(d)).alias(f"dim_{n}") for n, d in dims.items() if d.relation == name]
    found += [m.expr().alias(f"rel_{n}") for n, m in measures.items() if m.relation == name]
    related = rows.groupBy(*keys).agg(*(found or [F.count(F.lit(1)).alias(f"_n_{name}")]))
    on = [base[here] == related[f"_key_{i}"] for i, (here, _) in enumerate(relation.keys)]
    return base.join(related, on, "inner" if windowed or filters else "left").drop(*(f"_key_{i}" for i in range(len(keys))), f"_n_{name}")
