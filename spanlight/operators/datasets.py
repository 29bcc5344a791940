"""Dataset runs: latest items, run metrics, division, versions as of a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlight.functions.scalars import millis

from .tables import TRACE

ITEM = ("project_id", "dataset_id", "run_id", "item_id")


def latest_items(items: DataFrame) -> DataFrame:
    """The newest link of each item in each run: a struct maximum, which combines before the shuffle."""
    rest = [c for c in items.columns if c not in (*ITEM, "created_at", "seq")]
    return items.groupBy(*ITEM).agg(F.max(F.struct("created_at", "seq", *rest)).alias("x")).select(*ITEM, "x.*")


def run_metrics(items: DataFrame, spans: DataFrame, scores: DataFrame) -> DataFrame:
    """A row a run: items, average latency and total cost of their traces, and the number of their scores."""
    latest = latest_items(items)
    traces = spans.join(latest.select(*TRACE).distinct(), list(TRACE), "left_semi").groupBy(*TRACE).agg(F.sum("total_cost").alias("cost"), F.min("start_time").alias("first"), F.max("end_time").alias("last"))
    per_trace = scores.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_scores"))
    rows = latest.join(traces, list(TRACE), "left").join(per_trace, "trace_id", "left")
    return rows.groupBy("project_id", "dataset_id", "run_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.avg(millis("first", "last")).alias("avg_latency_ms"), F.sum("cost").alias("total_cost"), F.coalesce(F.sum("n_scores"), F.lit(0)).alias("n_scores"), F.min("created_at").alias("first_at"))


def in_all_runs(items: DataFrame, runs: list[str]) -> DataFrame:
    """Items that every one of the runs has (relational division): runs are counted by item."""
    rows = items.where(F.col("run_id").isin(runs)).groupBy("project_id", "dataset_id", "item_id").agg(F.count_distinct("run_id").alias("n"))
    return rows.where(F.col("n") == len(set(runs))).drop("n")


def compare_runs(items: DataFrame, spans: DataFrame, runs: list[str]) -> DataFrame:
    """Items side by side: a column of cost for each run."""
    costs = spans.groupBy(*TRACE).agg(F.sum("total_cost").alias("cost"))
    rows = latest_items(items).where(F.col("run_id").isin(runs)).join(costs, list(TRACE), "left")
    return rows.groupBy("project_id", "dataset_id", "item_id").pivot("run_id", runs).agg(F.sum("cost"))


def as_of(versions: DataFrame, at) -> DataFrame:
    """The version of each item that holds at a time."""
    t = F.lit(at).cast("timestamp_ntz")
    return versions.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def versions_at_runs(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """For each (item_id, at) the newest version that began by then: rows of both kinds in one order, with the last version carried on.
    One shuffle by item, and no range join."""
    both = versions.select("item_id", F.col("valid_from").alias("at"), F.lit(0).alias("kind"), "payload", "valid_from").unionByName(
        runs.select("item_id", "at", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("payload"), F.lit(None).cast("timestamp_ntz").alias("valid_from")))
    carried = both.selectExpr("item_id", "at", "kind", *(f"last({c}, true) OVER (PARTITION BY item_id ORDER BY at, kind ROWS UNBOUNDED PRECEDING) AS {c}" for c in ("payload", "valid_from")))
    return carried.where("kind = 1").select("item_id", "at", "payload", "valid_from")


def without_runs(spans: DataFrame, items: DataFrame) -> DataFrame:
    """Traces that no run item links."""
    return spans.select(*TRACE).distinct().join(items.select(*TRACE), list(TRACE), "left_anti")


def backfill(spans: DataFrame, items: DataFrame, tagged: DataFrame) -> DataFrame:
    """Spans with the run of the newest item that links their trace, for traces not tagged yet: the item's span is marked (its root if the item
    names none), and the mark is passed down to all descendants."""
    from .tree import propagate

    newest = items.withColumn("_obs", F.coalesce("observation_id", F.lit(""))).groupBy(*TRACE, "_obs").agg(F.max(F.struct("created_at", "seq", "run_id", "item_id")).alias("x"))
    newest = newest.join(tagged.select(*TRACE).distinct(), list(TRACE), "left_anti")
    linked = spans.select(*TRACE, "span_id", F.when(F.col("parent_span_id") == "", F.lit("")).alias("_root"))
    marks = linked.join(newest, list(TRACE)).where((F.col("_obs") == F.col("span_id")) | (F.col("_obs") == F.col("_root"))).select(*TRACE, "span_id", F.struct("x.run_id", "x.item_id").alias("run"))
    return propagate(spans.join(newest.select(*TRACE).distinct(), list(TRACE), "left_semi"), marks, "run").select(*TRACE, "span_id", "run.run_id", "run.item_id")
