"""Writing: partition rewrites, partial updates, deletes, retention, exports."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, files = _path(spark, path)
    return files.exists(p)


def replace_partitions(df: DataFrame, path: str, partition: str, touched: Iterable = ()) -> None:
    """Write df over the partitions it has rows for, and leave the others. It is staged first, in a folder of its own, since it may read what it
    replaces. Rows are dealt out by partition, and adaptive execution splits a large one over tasks. Partitions among ``touched`` that
    have no row any more are dropped."""
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}__staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    try:
        rows = spark.read.schema(df.schema).parquet(staged)
        rows.hint("rebalance", F.col(partition)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        left = {r[0] for r in rows.select(partition).distinct().collect()} if touched else set()
        for gone in set(touched) - left:
            p, files = _path(spark, f"{path.rstrip('/')}/{partition}={'__HIVE_DEFAULT_PARTITION__' if gone is None else gone}")
            files.delete(p, True)
    finally:
        p, files = _path(spark, staged)
        files.delete(p, True)


def delete_where(spark: SparkSession, path: str, condition: Column, partition: str) -> int:
    """Delete rows of a partitioned table; only partitions that hold such a row are read and rewritten. The number of rows that went."""
    if not exists(spark, path):
        return 0
    rows = spark.read.parquet(path)
    found = {r[0]: r["n"] for r in rows.where(condition).groupBy(partition).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    if found:
        days = [d for d in found if d is not None]
        within = F.col(partition).isin(days) | (F.col(partition).isNull() if None in found else F.lit(False))
        replace_partitions(rows.where(within & ~F.coalesce(condition, F.lit(False))), path, partition, found)
    return sum(found.values())


def latest(df: DataFrame, keys: Iterable[str], version: str) -> DataFrame:
    """The row of the highest version of each key, as a struct maximum."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in (*keys, version)]
    return df.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("x")).select(*keys, "x.*")


def updated(df: DataFrame, changes: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Partial update: the columns of ``changes`` replace those of the rows with equal keys, where they are not NULL."""
    keys = list(keys)
    new = [c for c in changes.columns if c not in keys]
    joined = df.join(changes.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in new)), keys, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in new else F.col(c) for c in df.columns))


def deleted(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """What stays, and a row that counts what goes."""
    gone = F.coalesce(condition, F.lit(False))
    return df.where(~gone), df.where(gone).agg(F.count(F.lit(1)).alias("n"))


def retained(df: DataFrame, cutoffs: DataFrame, time: str, tenant: str = "project_id") -> DataFrame:
    """Rows not older than their tenant's cutoff; tenants without one keep all. ``cutoffs`` has a row a tenant."""
    c = cutoffs.select(F.col(tenant).alias("_tenant"), F.col("cutoff").alias("_cutoff"))
    return df.join(c, F.col(tenant) == F.col("_tenant"), "left").where("_cutoff is null or " + time + " >= _cutoff").drop("_tenant", "_cutoff")


def export(df: DataFrame, path: str, kind: str) -> None:
    """CSV, JSON Lines or Parquet. Nested columns are JSON text in CSV."""
    if kind == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif kind in ("json", "jsonl"):
        df.write.mode("overwrite").json(path)
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"cannot export {kind!r}")


def with_score_columns(rows: DataFrame, scores: DataFrame, names: list[str], key: str = "trace_id") -> DataFrame:
    """Rows with a column for each named score: the average of its values."""
    flat = scores.where(F.col("name").isin(names)).groupBy(key).pivot("name", names).agg(F.avg("value"))
    return rows.join(flat, key, "left")


def window_of(df: DataFrame, time: str, last, now, frequency: str) -> DataFrame:
    """The rows of an incremental export: from the last run for one period, unless that is not over."""
    import datetime as dt

    step = {"hourly": dt.timedelta(hours=1), "daily": dt.timedelta(days=1), "weekly": dt.timedelta(days=7)}[frequency]
    end = last + step
    if end > now:
        return df.limit(0)
    return df.where((F.col(time) >= F.lit(last).cast("timestamp_ntz")) & (F.col(time) < F.lit(end).cast("timestamp_ntz")))


def literal(value) -> Column:
    """A typed literal of a query parameter: not-a-number and infinities are NULL, times without a zone are UTC."""
    import datetime as dt
    import math

    if isinstance(value, float) and not math.isfinite(value):
        return F.lit(None).cast("double")
    if isinstance(value, dt.datetime):
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value
        return F.lit(value.isoformat(sep=" ", timespec="microseconds")).cast("timestamp_ntz")
    if isinstance(value, Mapping):
        return F.create_map(*(F.lit(x) for pair in value.items() for x in pair))
    return F.lit(value)


def one_of(c: str, values: list) -> Column:
    """IN with a list that may be empty, which no row matches."""
    return F.col(c).isin(values) if values else F.lit(False)
