"""Equi-width histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """The 0-based bin of a score in bounds that are widened by a ten-thousandth, so that the highest value lies inside the last bin."""
    return F.floor((x - low) / ((high - low + F.lit(0.0001)) / bins)).cast("int")


def bin_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """The 0-based bin of a value; the highest value is in the last bin, and equal bounds make one bin."""
    width = (high - low) / bins
    return F.when(high == low, F.lit(0)).otherwise(F.least(F.floor(F.try_divide(x - low, width)), F.lit(bins - 1))).cast("int")


def binned(df: DataFrame, value: str, bins: int = 10, by: list[str] = ()) -> DataFrame:
    """(by, bin, lower, upper, count): each group's values in bins of equal width. Bounds come from a first aggregation, one row a group,
    that is joined back on the group."""
    rows = df.where(F.col(value).isNotNull())
    bounds = rows.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    if by:
        edge = bounds.select(*(F.col(c).alias(f"_by_{c}") for c in by), "_low", "_high")
        on = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
        placed = rows.join(edge, on).drop(*(f"_by_{c}" for c in by))
    else:
        placed = rows.crossJoin(F.broadcast(bounds))
    width = (F.col("_high") - F.col("_low")) / bins
    placed = placed.withColumn("bin", bin_of(F.col(value), F.col("_low"), F.col("_high"), bins))
    out = placed.groupBy(*by, "bin").agg(F.min("_low").alias("_low"), F.min("_high").alias("_high"), F.count(F.lit(1)).alias("count"))
    return out.select(*by, "bin", (F.col("_low") + F.col("bin") * width).alias("lower"), (F.col("_low") + (F.col("bin") + 1) * width).alias("upper"), "count")
