"""Reading results: bound SQL, streamed rows, and fetches of large fields for a batch of ids."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def query(spark: SparkSession, sql: str, params: Mapping | None = None, **frames: DataFrame) -> DataFrame:
    """SQL over the given frames, with its parameters bound as typed literals, never as text. Frames are named in braces."""
    return spark.sql(sql, args=dict(params or {}), **frames)


def stream(df: DataFrame, ahead: bool = True) -> Iterator[Row]:
    """The rows one by one, a partition at a time, so that the driver never holds them all."""
    return df.toLocalIterator(prefetchPartitions=ahead)


def large_fields(spans: DataFrame, wanted: DataFrame, columns: list[str], most_chars: int | None = None, slack: str = "1 second") -> DataFrame:
    """Large columns of wanted spans (project_id, trace_id, span_id, start_time), shortened if so asked. The wanted rows' range of time, with some
    slack, prunes the scan before the join by key."""
    span = wanted.agg((F.min("start_time") - F.expr(f"INTERVAL {slack}")).alias("_from"), (F.max("start_time") + F.expr(f"INTERVAL {slack}")).alias("_to"))
    near = spans.join(F.broadcast(span), (F.col("start_time") >= F.col("_from")) & (F.col("start_time") <= F.col("_to"))).drop("_from", "_to")
    keys = ["project_id", "trace_id", "span_id"]
    found = near.join(wanted.select(*keys).distinct(), keys, "left_semi")
    return found.select(*keys, *(F.substring(F.col(c).cast("string"), 1, most_chars).alias(c) if most_chars else F.col(c) for c in columns))


def traces_having(spans: DataFrame, root_condition, level: str, slack: str = "2 days") -> DataFrame:
    """(project_id, trace_id) of traces whose root meets a condition and that have a span of a level near it in time."""
    keys = ["project_id", "trace_id"]
    roots = spans.where("parent_span_id = ''").where(root_condition).select(*keys, F.col("start_time").alias("_root_time"))
    hits = spans.where(F.col("level") == level).select(*keys, "start_time").join(roots, keys)
    near = F.col("start_time").between(F.col("_root_time") - F.expr(f"INTERVAL {slack}"), F.col("_root_time") + F.expr(f"INTERVAL {slack}"))
    return hits.where(near).select(*keys).distinct()
