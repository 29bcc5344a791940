"""One score against another: matched pairs, distributions, heatmap, confusion, correlations and agreement.

Functions return typed DataFrames. Pairs are matched on trace, observation, session and run, where NULL and blank are
equal. Nothing is capped; a hash sample is there for those who want less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanlight.functions.scalars import sampled
from spanlight.session import cut, sized

from .histogram import score_bin
from .timeseries import bucket

KEYS = ("trace_id", "observation_id", "session_id", "run_id")
UNMATCHED = "__unmatched__"


def chosen(scores: DataFrame, name: str, source: str | None = None, data_type: str | None = None, start=None, end=None) -> DataFrame:
    """The scores of one name, in a time range that includes both ends."""
    out = scores.where(F.col("name") == name)
    for c, v in (("source", source), ("data_type", data_type)):
        out = out if v is None else out.where(F.col(c) == v)
    if start is not None:
        out = out.where((F.col("timestamp") >= F.lit(start).cast("timestamp_ntz")) & (F.col("timestamp") <= F.lit(end).cast("timestamp_ntz")))
    return out


def sample(scores: DataFrame, rate: float) -> DataFrame:
    """A share of the scores that is the same on every run: chosen by a hash of what they are matched on."""
    return scores.where(sampled(F.concat_ws("|", *(F.coalesce(k, F.lit("")) for k in KEYS[:3])), rate))


def category() -> Column:
    """A score's category: its string value, or else its number as text."""
    return F.coalesce("string_value", F.col("value").cast("string"))


def _keys(df: DataFrame, keys: tuple[str, ...], n: int) -> DataFrame:
    return df.select(*(F.coalesce(k, F.lit("")).alias(f"k_{k}") for k in keys), F.col("id").alias(f"id{n}"), F.col("value").alias(f"value{n}"), category().alias(f"category{n}"), F.col("timestamp").alias(f"timestamp{n}"))


def matched(first: DataFrame, second: DataFrame, keys: tuple[str, ...] = KEYS, same: bool = False) -> DataFrame:
    """Pairs of scores of one object; a score compared with itself is matched by id."""
    if same:
        return _keys(first, keys, 1).join(_keys(second, (), 2), F.col("id1") == F.col("id2"))
    return _keys(first, keys, 1).join(_keys(second, keys, 2), [f"k_{k}" for k in keys])


def counts(first: DataFrame, second: DataFrame, pairs: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(first, "n1").crossJoin(one(second, "n2")).crossJoin(one(pairs, "n_matched"))


def heatmap(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """Pairs by the bins of both values, each in its own bounds, which one row of a first aggregation holds."""
    rows = pairs.where("value1 is not null and value2 is not null")
    edge = rows.agg(F.min("value1").alias("l1"), F.max("value1").alias("h1"), F.min("value2").alias("l2"), F.max("value2").alias("h2"))
    rows = rows.crossJoin(F.broadcast(edge))
    return rows.groupBy(score_bin(F.col("value1"), F.col("l1"), F.col("h1"), bins).alias("bin_x"), score_bin(F.col("value2"), F.col("l2"), F.col("h2"), bins).alias("bin_y")).agg(F.count(F.lit(1)).alias("count"))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.where("category1 is not null and category2 is not null").groupBy("category1", "category2").agg(F.count(F.lit(1)).alias("count"))


def distribution(scores: DataFrame, value: str = "value", bins: int = 10, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """A score's values by bin, in its own bounds or in given ones."""
    rows = scores.where(F.col(value).isNotNull())
    if low is None:
        rows = rows.crossJoin(F.broadcast(rows.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))))
        low, high = F.col("_low"), F.col("_high")
    return rows.groupBy(score_bin(F.col(value), low, high, bins).alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def shared_distribution(first: DataFrame, second: DataFrame, bins: int = 10) -> DataFrame:
    """Both scores by bin in their common bounds."""
    both = first.select(F.lit(1).alias("which"), "value").unionByName(second.select(F.lit(2).alias("which"), "value")).where("value is not null")
    both = both.crossJoin(F.broadcast(both.agg(F.min("value").alias("_low"), F.max("value").alias("_high"))))
    return both.groupBy("which", score_bin(F.col("value"), F.col("_low"), F.col("_high"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def categories(scores: DataFrame) -> DataFrame:
    """Categories with their counts and their place in alphabetical order."""
    out = scores.where("string_value is not null or value is not null").groupBy(category().alias("category")).agg(F.count(F.lit(1)).alias("count"))
    return out.withColumn("place", F.row_number().over(Window.orderBy("category")) - 1)


def stacked(first: DataFrame, second: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Categories of the first score split by those of the second; what has none is unmatched."""
    rows = _keys(first, keys, 1).join(_keys(second, keys, 2), [f"k_{k}" for k in keys], "left")
    return rows.groupBy("category1", F.coalesce("category2", F.lit(UNMATCHED)).alias("category2")).agg(F.count(F.lit(1)).alias("count"))


def timeseries(first: DataFrame, second: DataFrame, granularity: str) -> DataFrame:
    """Averages of both scores by bucket; a bucket that only one has is kept."""
    by = lambda df, n: df.groupBy(bucket("timestamp", granularity).alias("time_dimension")).agg(F.avg("value").alias(f"avg{n}"), F.count(F.lit(1)).alias(f"n{n}"))
    return by(first, 1).join(by(second, 2), "time_dimension", "full_outer")


def timeseries_matched(pairs: DataFrame, granularity: str) -> DataFrame:
    return pairs.groupBy(bucket("timestamp1", granularity).alias("time_dimension")).agg(F.avg("value1").alias("avg1"), F.avg("value2").alias("avg2"), F.count(F.lit(1)).alias("count"))


def timeseries_categories(scores: DataFrame, granularity: str) -> DataFrame:
    return scores.where("string_value is not null").groupBy(bucket("timestamp", granularity).alias("time_dimension"), F.col("string_value").alias("category")).agg(F.count(F.lit(1)).alias("count"))


def average_ranks(pairs: DataFrame, column: str, out: str) -> DataFrame:
    """Ranks with ties averaged. Ranks are running counts over the distinct values, which are few beside the rows: the values' counts
    are ranged by value, each range's total is summed up, and the sums are joined back."""
    values = pairs.groupBy(column).agg(F.count(F.lit(1)).alias("_m"))
    # stored, as each evaluation of the range partitioning may cut elsewhere
    ranged = cut(values.repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum("_m").alias("_t"))
    before = totals.select("_part", (F.sum("_t").over(Window.orderBy("_part")) - F.col("_t")).alias("_before"))
    inside = ranged.withColumn("_upto", F.sum("_m").over(Window.partitionBy("_part").orderBy(column)))
    ranks = inside.join(F.broadcast(before), "_part").select(column, (F.col("_before") + F.col("_upto") - (F.col("_m") - 1) / 2).alias(out))
    return pairs.join(ranks, column)


def statistics(first: DataFrame, second: DataFrame, pairs: DataFrame) -> DataFrame:
    """Means and deviations of both scores; errors and correlations of the pairs (NULL where a side is constant)."""
    own = lambda df, n: df.agg(F.avg("value").alias(f"mean{n}"), F.stddev_pop("value").alias(f"std{n}"))
    rows = pairs.where("value1 is not null and value2 is not null").select("value1", "value2")
    ranked = average_ranks(average_ranks(rows, "value1", "r1"), "value2", "r2")
    gap = F.col("value1") - F.col("value2")
    guarded = lambda a, b: F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)))
    joint = ranked.agg(F.count(F.lit(1)).alias("n_matched"), guarded("value1", "value2").alias("pearson"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), guarded("r1", "r2").alias("spearman"))
    return joint.crossJoin(own(first, 1)).crossJoin(own(second, 2))


def agreement(table: DataFrame) -> DataFrame:
    """Cohen's kappa, weighted F1 and overall agreement of a confusion table."""
    total = table.agg(F.sum("count").alias("n"), F.sum(F.when(F.col("category1") == F.col("category2"), F.col("count")).otherwise(0)).alias("same"))
    rows = table.groupBy(F.col("category1").alias("c")).agg(F.sum("count").alias("a"))
    cols = table.groupBy(F.col("category2").alias("c")).agg(F.sum("count").alias("b"))
    hits = table.where("category1 = category2").select(F.col("category1").alias("c"), F.col("count").alias("hit"))
    per = rows.join(cols, "c", "full_outer").join(hits, "c", "left").na.fill(0, ["a", "b", "hit"]).crossJoin(F.broadcast(total))
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("a") + F.col("b")), F.lit(0.0))
    out = per.agg(F.max("n").alias("n"), F.max("same").alias("same"), F.sum(F.col("a") * F.col("b")).alias("_e"), F.sum(f1 * F.col("a")).alias("_f"))
    observed, expected = F.col("same") / F.col("n"), F.col("_e") / (F.col("n") * F.col("n"))
    kappa = F.when(expected == 1, F.lit(1.0)).otherwise((observed - expected) / (1 - expected))
    return out.where("n is not null").select("n", observed.alias("agreement"), kappa.alias("kappa"), (F.col("_f") / F.col("n")).alias("weighted_f1"))


#: The two categories of a boolean score, in the order of a chart.
BOOLEAN_CATEGORIES = ("False", "True")


def category_domain(scores: DataFrame, data_type: str) -> DataFrame:
    """The categories of a chart: both values of a boolean score, whatever stands in the rows, else those that the rows have."""
    if data_type == "BOOLEAN":
        return scores.sparkSession.createDataFrame([(c,) for c in BOOLEAN_CATEGORIES], "category string")
    return scores.select(category().alias("category")).where("category is not null").distinct()


def filled_categories(scores: DataFrame, data_type: str) -> DataFrame:
    """Counts by category, 0 for a category of the domain that no row has."""
    found = scores.groupBy(category().alias("category")).agg(F.count(F.lit(1)).alias("count"))
    return category_domain(scores, data_type).join(found, "category", "left").select("category", F.coalesce("count", F.lit(0)).alias("count"))


def filled_bins(counts: DataFrame, bins: int, bin: str = "bin", count: str = "count") -> DataFrame:
    """All bins of a histogram, 0 for those without a row."""
    every = counts.sparkSession.range(bins).select(F.col("id").cast("int").alias(bin))
    return every.join(counts.select(bin, count), bin, "left").select(bin, F.coalesce(count, F.lit(0)).alias(count))


def most_frequent(scores: DataFrame, *keys: str) -> DataFrame:
    """(keys, mode, count): the most frequent category of each key, the first by name of equally frequent ones."""
    counts = scores.where(category().isNotNull()).groupBy(*keys, category().alias("mode")).agg(F.count(F.lit(1)).alias("count"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("count")).alias("_n"), "mode")).alias("x")).select(*keys, "x.mode", (-F.col("x._n")).alias("count"))


def root_histogram(scores: DataFrame, value: str = "value") -> DataFrame:
    """A histogram with as many bins as the square root of the number of values, rounded up."""
    rows = scores.where(F.col(value).isNotNull())
    edge = rows.agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.ceil(F.sqrt(F.count(F.lit(1)))).cast("int").alias("bins"))
    width = (F.col("_high") - F.col("_low")) / F.col("bins")
    at = F.when(F.col("_high") == F.col("_low"), F.lit(0)).otherwise(F.least(F.floor(F.try_divide(F.col(value) - F.col("_low"), width)), F.col("bins") - 1)).cast("int")
    return rows.crossJoin(F.broadcast(edge)).groupBy(at.alias("bin"), "bins").agg(F.count(F.lit(1)).alias("count"))


def filled_category_series(series: DataFrame, times: DataFrame, time: str = "time_dimension") -> DataFrame:
    """A row for each bucket of ``times`` and each category of the series, 0 where the series has none. The buckets and the categories of a chart are
    few, and both are counted before the frame is broadcast."""
    frame = times.select(time).crossJoin(sized(series.select("category").distinct()))
    return frame.join(series, [time, "category"], "left").select(time, "category", F.coalesce("count", F.lit(0)).alias("count"))
