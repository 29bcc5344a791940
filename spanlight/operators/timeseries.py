"""Time buckets, automatic granularity and gap filling."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRANULARITIES = ("minute", "hour", "day", "week", "month")
#: Candidate bucket lengths in seconds for charts of about 50 buckets.
BUCKET_SECONDS = (5, 10, 30, 60, 300, 600, 1800, 3600, 18000, 36000, 86400, 604800, 2592000)


def auto_granularity(start: dt.datetime, end: dt.datetime) -> str:
    """The granularity that a range of time calls for."""
    hours = (end - start).total_seconds() / 3600
    return next((name for name, most in (("minute", 2), ("hour", 72), ("day", 1440), ("week", 8760)) if hours < most), "month")


def bucket(c: Column | str, granularity: str) -> Column:
    """The start of the bucket a time lies in; weeks begin on Monday. The result has no time zone, as its input."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"unknown granularity {granularity!r}")
    return F.date_trunc(granularity, c).cast("timestamp_ntz")


def bucket_seconds(start: dt.datetime, end: dt.datetime, wanted: int = 50) -> int:
    """Of the candidate lengths, the one that comes nearest to the wanted number of buckets."""
    span = (end - start).total_seconds()
    return min(BUCKET_SECONDS, key=lambda s: abs(span / s - wanted))


def coarse_bucket(c: Column | str, seconds: int) -> Column:
    """Truncation to days, hours or minutes for lengths of at least one, else to whole lengths since the epoch."""
    for name, least in (("day", 86400), ("hour", 3600), ("minute", 60)):
        if seconds >= least:
            return bucket(c, name)
    return floored(c, seconds)


def floored(c: Column | str, seconds: int) -> Column:
    """Whole multiples of a length since the epoch."""
    c = F.col(c) if isinstance(c, str) else c
    at = F.unix_seconds(c.cast("timestamp"))
    return F.timestamp_seconds(at - F.pmod(at, F.lit(seconds))).cast("timestamp_ntz")


def normalise_interval(count: int, unit: str) -> tuple[int, str]:
    """An interval as one that buckets can be made of: 7 days are a week, several units count as one where they are one bucket."""
    unit = unit.rstrip("s")
    return (1, "week") if (count, unit) == (7, "day") else (count, unit)


def calendar(spark: SparkSession, start: dt.datetime, end: dt.datetime, granularity: str, name: str = "time_dimension") -> DataFrame:
    """A row for each bucket from that of ``start`` to that of ``end``; months are calendar months."""
    step = {"minute": "1 minute", "hour": "1 hour", "day": "1 day", "week": "7 days", "month": "1 month"}[granularity]
    ends = [F.date_trunc(granularity, F.lit(t.isoformat(sep=" ")).cast("timestamp")) for t in (start, end)]
    times = F.sequence(*ends, F.expr(f"INTERVAL {step}"))
    return spark.range(1).select(F.explode(times).alias(name)).select(F.col(name).cast("timestamp_ntz"))


def fill_gaps(df: DataFrame, start: dt.datetime, end: dt.datetime, granularity: str, metrics: list[str], dimensions: list[str] = (), time: str = "time_dimension") -> DataFrame:
    """The rows plus the buckets that have none. Without dimensions, missing metrics are 0; with dimensions, one row a missing bucket
    has NULL metrics and, for each dimension, NULL if that is ever NULL and '' otherwise. An empty input stays empty."""
    spark = df.sparkSession
    times = calendar(spark, start, end, granularity, time)
    some = df.limit(1).select(F.lit(True).alias("_some"))
    if not dimensions:
        rows = times.join(df, time, "left").crossJoin(F.broadcast(some)).drop("_some")
        return rows.select(time, *(F.coalesce(m, F.lit(0)).cast(df.schema[m].dataType).alias(m) for m in metrics))
    missing = times.join(df.select(time).distinct(), time, "left_anti")
    blank = df.agg(*(F.max(F.col(d).isNull()).alias(d) for d in dimensions), F.count(F.lit(1)).alias("_n")).where("_n > 0")
    extra = missing.crossJoin(F.broadcast(blank)).select(
        time, *(F.when(F.col(d), F.lit(None)).otherwise(F.lit("")).cast(df.schema[d].dataType).alias(d) for d in dimensions), *(F.lit(None).cast(df.schema[m].dataType).alias(m) for m in metrics))
    return df.select(time, *dimensions, *metrics).unionByName(extra)


def densify(df: DataFrame, kinds: DataFrame, kind: str, value: str, time: str = "time_dimension") -> DataFrame:
    """Every kind in every bucket that has any, 0 where a kind lacks it. ``kinds`` is a short list of names (counted by the caller)."""
    frame = df.select(time).distinct().crossJoin(F.broadcast(kinds.select(kind).distinct()))
    return frame.join(df.select(time, kind, value), [time, kind], "left").select(time, kind, F.coalesce(value, F.lit(0)).cast(df.schema[value].dataType).alias(value))


def with_edges(df: DataFrame, start: dt.datetime, end: dt.datetime, key: str, value: str, time: str = "time_dimension") -> DataFrame:
    """The rows plus, for each key, zero rows at the range's two ends where it has none."""
    ends = df.select(key).distinct().select(F.explode(F.array(*(F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz") for t in (start, end)))).alias(time), key)
    missing = ends.join(df.select(time, key), [time, key], "left_anti").withColumn(value, F.lit(0).cast(df.schema[value].dataType))
    return df.select(time, key, value).unionByName(missing)


def up_to_last(df: DataFrame, start: dt.datetime, granularity: str, metrics: list[str], time: str = "time_dimension") -> DataFrame:
    """Buckets from ``start`` to the last one with data; metrics are NULL in those that have none."""
    step = {"minute": "1 minute", "hour": "1 hour", "day": "1 day", "week": "7 days", "month": "1 month"}[granularity]
    first = F.date_trunc(granularity, F.lit(start.isoformat(sep=" ")).cast("timestamp"))
    last = df.agg(F.max(time).cast("timestamp").alias("last")).where("last is not null")
    times = last.select(F.explode(F.sequence(first, F.col("last"), F.expr(f"INTERVAL {step}"))).alias(time)).select(F.col(time).cast("timestamp_ntz"))
    return times.join(df.select(time, *metrics), time, "left")


def rebucket(df: DataFrame, seconds: int, end: dt.datetime, sums: list[str], time: str = "time_dimension") -> DataFrame:
    """Rows summed into longer buckets that are counted backwards from ``end``; a bucket is named by its start."""
    to = F.lit(end.isoformat(sep=" ")).cast("timestamp_ntz")
    back = F.floor(F.timestamp_diff("SECOND", F.col(time), to) / seconds)
    start = F.timestamp_add("SECOND", ((-(back + 1)) * seconds).cast("int"), to)
    return df.groupBy(start.alias(time)).agg(*(F.sum(c).alias(c) for c in sums))
