"""Span trees: descendants, heights and costs rolled up to ancestors, marks passed down.

Trees lie within a trace. Sums and marks are made by pointer jumping: every span has a pointer to an ancestor, which is twice as far away
after each round, and what it has gathered below (or found above) so far. A round has one row a span, and a tree of depth d takes log2(d)
rounds, however deep; nothing is cut off. Rounds are cut by checkpoints.

Spans whose pointers never end are on a cycle or below one, which shows when a round ends no pointer. The spans of a cycle have the
same descendants, so for sums they count as one span, and each gets that one's result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.session import cut

TRACE = ("project_id", "trace_id")


def _linked(spans: DataFrame, *columns: Column) -> DataFrame:
    """(project_id, trace_id, span_id, up) and more columns; up is the parent, or NULL if the trace lacks it."""
    parent = F.when((F.col("parent_span_id") != "") & (F.col("parent_span_id") != F.col("span_id")), F.col("parent_span_id"))
    known = spans.select(*TRACE, F.col("span_id").alias("up"), F.lit(True).alias("_known"))
    rows = spans.select(*TRACE, "span_id", parent.alias("up"), *columns).join(known, [*TRACE, "up"], "left")
    return rows.withColumn("up", F.when(F.col("_known"), F.col("up"))).drop("_known")


def _either(a: str, b: str) -> Column:
    """A sum of two values that may be NULL."""
    return F.when(F.col(a).isNull(), F.col(b)).when(F.col(b).isNull(), F.col(a)).otherwise(F.col(a) + F.col(b))


def _gathered(now: DataFrame, kind: str) -> DataFrame:
    """(…, span_id, up, total, below, height, low): what spans gather from all their descendants; up stays set only at and below cycles,
    where low is the least span id of the cycle."""
    step, left, mark = 1, None, None
    now = cut(now)
    while True:
        seen = now.where("up is not null").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("span_id", "low").cast("decimal(38, 0)")).alias("s")).first()
        if not seen["n"] or (seen["n"] == left and seen["s"] == mark):
            return now
        left, mark = seen["n"], seen["s"]
        from_below = now.where("up is not null").groupBy(*TRACE, F.col("up").alias("span_id")).agg(
            F.sum("total").cast(kind).alias("_total"), F.sum(F.col("below") + 1).alias("_below"), F.max(F.col("height") + step).alias("_height"))
        above = now.select(*TRACE, F.col("span_id").alias("up"), F.col("up").alias("_up"), F.col("low").alias("_low"))
        rows = now.join(from_below, [*TRACE, "span_id"], "left").join(above, [*TRACE, "up"], "left")
        now = cut(rows.select(
            *TRACE, "span_id", F.col("_up").alias("up"), _either("total", "_total").cast(kind).alias("total"), (F.col("below") + F.coalesce("_below", F.lit(0))).alias("below"),
            F.greatest("height", "_height").alias("height"), F.least("low", "_low").alias("low")))
        step *= 2


def rolled_up(spans: DataFrame, value: str | Column = "total_cost") -> DataFrame:
    """A span's value with those of all its descendants, how many there are, and how deep they go."""
    name = value if isinstance(value, str) else "total_cost"
    links = _linked(spans, (F.col(value) if isinstance(value, str) else value).alias("total"))
    kind = links.agg(F.sum("total").alias("t")).schema["t"].dataType.simpleString()
    if kind.startswith("decimal"):
        kind = f"decimal(38, {kind.rstrip(')').split(',')[1]})"
    start = links.select(*TRACE, "span_id", "up", F.col("total").cast(kind).alias("total"), F.lit(0).cast("bigint").alias("below"), F.lit(0).alias("height"), F.col("span_id").alias("low"))
    found = _gathered(start, kind)
    columns = [F.col("total").alias(name), F.col("below").alias("n_descendants"), "height"]
    ring = cut(found.where("up is not null").select(*TRACE, F.col("up").alias("span_id")).distinct().join(found.select(*TRACE, "span_id", F.col("low").alias("one")), [*TRACE, "span_id"]))
    if ring.isEmpty():
        return found.select(*TRACE, "span_id", *columns)
    inside = start.join(ring, [*TRACE, "span_id"], "left")
    one = inside.where("one is not null").groupBy(*TRACE, F.col("one").alias("span_id")).agg(F.sum("total").cast(kind).alias("total"), (F.count(F.lit(1)) - 1).alias("below"))
    one = one.select(*TRACE, "span_id", F.lit(None).cast("string").alias("up"), "total", "below", F.lit(0).alias("height"), F.col("span_id").alias("low"))
    rest = inside.where("one is null").drop("one").join(ring.select(*TRACE, F.col("span_id").alias("up"), "one"), [*TRACE, "up"], "left").withColumn("up", F.coalesce("one", "up")).drop("one")
    found = _gathered(rest.unionByName(one), kind).select(*TRACE, "span_id", *columns)
    of_ring = ring.join(found.withColumnRenamed("span_id", "one"), [*TRACE, "one"]).drop("one")
    return found.join(ring.select(*TRACE, "span_id"), [*TRACE, "span_id"], "left_anti").unionByName(of_ring)


def own_cost(total: str = "total_cost", details: str = "cost_details") -> Column:
    """A span's cost: its total if that is not zero, else input and output together."""
    part = lambda k: F.coalesce(F.try_element_at(details, F.lit(k)), F.lit(0))
    return F.when(F.coalesce(total, F.lit(0)) != 0, F.col(total)).otherwise(part("input") + part("output"))


def recursive_cost(spans: DataFrame) -> DataFrame:
    """Each span's own cost with its descendants'; a sum of nothing but zeros is NULL."""
    out = rolled_up(spans, own_cost())
    return out.withColumn("total_cost", F.when(F.col("total_cost") != 0, F.col("total_cost")))


def propagate(spans: DataFrame, marks: DataFrame, column: str) -> DataFrame:
    """Each span with the mark of its nearest marked ancestor, itself included; spans without one are left out. ``marks``: (project_id, trace_id,
    span_id, column)."""
    rows = _linked(spans).join(marks.select(*TRACE, "span_id", F.struct(F.col(column).alias("v")).alias("mark")), [*TRACE, "span_id"], "left")
    now, left = cut(rows.withColumn("up", F.when(F.col("mark").isNull(), F.col("up")))), None
    while True:
        n = now.where("up is not null").count()
        if not n or n == left:  # a round that ends none: only cycles without a mark are left
            return now.where("mark is not null").select(*TRACE, "span_id", F.col("mark.v").alias(column))
        left = n
        above = now.select(*TRACE, F.col("span_id").alias("up"), F.col("up").alias("_up"), F.col("mark").alias("_mark"))
        rows = now.join(above, [*TRACE, "up"], "left").select(*TRACE, "span_id", "_up", F.coalesce("mark", "_mark").alias("mark"))
        now = cut(rows.select(*TRACE, "span_id", F.when(F.col("mark").isNull(), F.col("_up")).alias("up"), "mark"))


def ancestors(spans: DataFrame) -> DataFrame:
    """(project_id, trace_id, span_id, ancestor, distance) for all ancestors, the span itself included. The pairs of a result that lists pairs:
    their number doubles in reach each round, until none is new."""
    pairs = _linked(spans).where("up is not null").select(*TRACE, "span_id", F.col("up").alias("ancestor"), F.lit(1).alias("distance"))
    pairs, n = cut(pairs), None
    while n != (now := pairs.count()):
        n = now
        further = pairs.alias("a").join(pairs.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in TRACE] + [F.col("a.ancestor") == F.col("b.span_id")]).select(
            *(F.col(f"a.{c}").alias(c) for c in TRACE), F.col("a.span_id").alias("span_id"), F.col("b.ancestor").alias("ancestor"), (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        pairs = cut(pairs.unionByName(further).groupBy(*TRACE, "span_id", "ancestor").agg(F.min("distance").alias("distance")))
    own = spans.select(*TRACE, "span_id", F.col("span_id").alias("ancestor"), F.lit(0).alias("distance"))
    return own.unionByName(pairs.where("span_id <> ancestor"))


def descendants(spans: DataFrame, start: DataFrame) -> DataFrame:
    """Spans at or below the (project_id, trace_id, span_id) rows of ``start``."""
    roots = start.select(*TRACE, F.col("span_id").alias("ancestor"))
    return ancestors(spans).join(roots, [*TRACE, "ancestor"]).select(*TRACE, "ancestor", "span_id", "distance")
