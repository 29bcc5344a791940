"""The list tables (traces, sessions, users, observations, scores), their facets and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlight.functions.scalars import array_size, blank_to_null, key_sum, latest_non_empty, level_of, millis, seconds, severity, with_fallback

TRACE = ("project_id", "trace_id")


def roots(spans: DataFrame) -> DataFrame:
    return spans.where(F.coalesce("parent_span_id", F.lit("")) == "")


def latest_root(spans: DataFrame, extra: tuple[str, ...] = ("span_id",)) -> DataFrame:
    """The newest root of each trace."""
    w = Window.partitionBy(*TRACE).orderBy(F.col("event_ts").desc(), *(F.col(c).desc() for c in extra))
    return roots(spans).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def trace_scalars(spans: DataFrame) -> DataFrame:
    """A trace's scalars, each from the newest span that has one."""
    order = ("event_ts", "span_id")
    out = spans.groupBy(*TRACE).agg(
        *(latest_non_empty(c, *order).alias(c) for c in ("user_id", "session_id", "environment", "release", "version", "trace_name")),
        F.min("start_time").alias("first_start"), F.count(F.lit(1)).alias("n_spans"))
    return out


def observation_stats(spans: DataFrame) -> DataFrame:
    """A row a trace over its non-root spans: counts by level, severity, latency, tokens and cost."""
    child = spans.where(F.coalesce("parent_span_id", F.lit("")) != "")
    starts, ends = F.max("start_time"), F.max("end_time")
    out = child.groupBy(*TRACE).agg(
        F.count(F.lit(1)).alias("n_observations"), *(F.count_if(F.col("level") == x).alias(f"n_{x.lower()}") for x in ("DEBUG", "DEFAULT", "WARNING", "ERROR")),
        F.max(severity("level")).alias("_level"), F.when(starts > ends, starts).otherwise(ends).alias("_last"), F.min("start_time").alias("_first"),
        F.sum(key_sum("usage_details", "input")).alias("input_tokens"), F.sum(key_sum("usage_details", "output")).alias("output_tokens"),
        F.sum(F.col("usage_details")["total"]).alias("total_tokens"), F.sum("total_cost").alias("total_cost"))
    return out.select(*TRACE, "n_observations", "n_debug", "n_default", "n_warning", "n_error", level_of(F.col("_level")).alias("level"), millis("_first", "_last").alias("latency_ms"),
                      F.col("input_tokens").cast("bigint"), F.col("output_tokens").cast("bigint"), "total_tokens", "total_cost")


def map_sums(spans: DataFrame, column: str, by: tuple[str, ...] = TRACE) -> DataFrame:
    """Values of a map column summed by key, back as a map a group."""
    rows = spans.select(*by, F.explode(column).alias("k", "v")).groupBy(*by, "k").agg(F.sum("v").alias("v"))
    return rows.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(column))


def score_lists(scores: DataFrame, by: tuple[str, ...] = ("trace_id",)) -> DataFrame:
    """Averages of numeric scores and 'name:value' categories, as sorted lists a group: averaged by name first. Averages are not rounded: who floors or
    compares them needs them as they are."""
    each = scores.groupBy(*by, "name", "data_type", "string_value").agg(F.avg("value").alias("avg"))
    numeric = F.col("data_type").isin("NUMERIC", "BOOLEAN")
    return each.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.when(numeric, F.struct("name", "avg")))).alias("scores_avg"),
        F.array_sort(F.collect_list(F.when(~numeric & F.col("string_value").isNotNull(), F.concat("name", F.lit(":"), "string_value")))).alias("categories"))


def traces_table(spans: DataFrame, scores: DataFrame | None = None, with_stats: bool = True) -> DataFrame:
    """A row a trace: its root, and, only where asked for, its observations' statistics and its scores."""
    out = roots(spans).select(*TRACE, "span_id", "start_time", with_fallback("trace_name", "name").alias("name"), "user_id", "session_id", "environment", "release", "version", "tags", "event_ts")
    if with_stats:
        out = out.join(observation_stats(spans), list(TRACE), "left")
    if scores is not None:
        out = out.join(score_lists(scores), "trace_id", "left")
    return out


def sessions_table(spans: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """A row a session of root spans, with its traces' observations; tags are gathered on their own so they multiply nothing."""
    root = roots(spans).where(F.coalesce("session_id", F.lit("")) != "")
    stats = observation_stats(spans)
    rows = root.select("project_id", "session_id", "trace_id", "user_id", "environment", "start_time", "end_time").join(stats, list(TRACE), "left")
    out = rows.groupBy("project_id", "session_id").agg(
        F.min("start_time").alias("first_at"), F.max("start_time").alias("last_at"), F.count_distinct("trace_id").alias("n_traces"),
        F.array_sort(F.collect_set(blank_to_null("user_id"))).alias("user_ids"), F.min("environment").alias("environment"),
        F.sum("n_observations").alias("n_observations"), F.sum("total_tokens").alias("total_tokens"), F.sum("total_cost").alias("total_cost"))
    out = out.withColumn("duration_s", seconds("first_at", "last_at"))
    tags = root.select("project_id", "session_id", F.explode_outer("tags").alias("tag")).groupBy("project_id", "session_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    out = out.join(tags, ["project_id", "session_id"])
    if scores is not None:
        n = scores.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_scores"))
        out = out.join(n, "session_id", "left").withColumn("n_scores", F.coalesce("n_scores", F.lit(0)))
    return out


def users_table(spans: DataFrame) -> DataFrame:
    """Metrics of each user over all spans that carry the user's id."""
    rows = spans.where(F.coalesce("user_id", F.lit("")) != "")
    return rows.groupBy("project_id", "user_id").agg(
        F.count_distinct("trace_id").alias("n_traces"), F.count(F.lit(1)).alias("n_spans"), F.min("start_time").alias("first_at"), F.max("start_time").alias("last_at"),
        F.sum(key_sum("usage_details", "input")).cast("bigint").alias("input_tokens"), F.sum(key_sum("usage_details", "output")).cast("bigint").alias("output_tokens"),
        F.sum(F.col("usage_details")["total"]).alias("total_tokens"), F.sum("total_cost").alias("total_cost"))


def users_by_roots(spans: DataFrame) -> DataFrame:
    """The same where a user's spans are those of the traces whose root names the user."""
    root = roots(spans).where(F.coalesce("user_id", F.lit("")) != "").select("project_id", "trace_id", F.col("user_id").alias("of"))
    rows = spans.join(root, list(TRACE))
    return rows.groupBy("project_id", F.col("of").alias("user_id")).agg(F.count_distinct("trace_id").alias("n_traces"), F.count_if(F.col("parent_span_id") != "").alias("n_observations"), F.sum("total_cost").alias("total_cost"))


def observations_table(spans: DataFrame) -> DataFrame:
    """A row an observation, with what it lacks taken from its trace's root."""
    root = roots(spans).select(*TRACE, F.col("environment").alias("r_environment"), F.col("user_id").alias("r_user"), F.col("name").alias("r_name"))
    rows = spans.where(F.col("parent_span_id") != "").join(root, list(TRACE), "left")
    return rows.select(
        *TRACE, "span_id", "type", "name", "level", with_fallback("environment", "r_environment").alias("environment"), with_fallback("user_id", "r_user").alias("user_id"), F.col("r_name").alias("trace_name"),
        "start_time", millis("start_time", "end_time").alias("latency_ms"), millis("start_time", "completion_start_time").alias("ttft_ms"), "provided_model_name",
        F.col("usage_details")["total"].alias("total_tokens"), "total_cost", array_size("tool_definitions").alias("n_tool_definitions"), array_size("tool_call_names").alias("n_tool_calls"),
        (array_size("metadata") > 0).alias("has_metadata"))


def scores_table(scores: DataFrame, spans: DataFrame) -> DataFrame:
    """Scores with their trace's name, user and tags."""
    root = roots(spans).select("trace_id", F.col("name").alias("trace_name"), "user_id", "tags")
    return scores.join(root, "trace_id", "left").select("id", "trace_id", "name", "source", "data_type", "value", "string_value", "timestamp", "trace_name", "user_id", F.array_sort("tags").alias("tags"), (F.col("metadata") != "").alias("has_metadata"))


def facet(df: DataFrame, c: str | Column, name: str = "value", limit: int | None = 1000) -> DataFrame:
    """Values of a column with their counts, most frequent first; NULL and blank are left out."""
    out = df.select((F.col(c) if isinstance(c, str) else c).alias(name)).where(F.col(name).isNotNull())
    if dict(out.dtypes)[name] == "string":
        out = out.where(F.col(name) != "")
    out = out.groupBy(name).agg(F.count(F.lit(1)).alias("count"))
    return out.orderBy(F.col("count").desc(), F.col(name)).limit(limit) if limit else out


def array_facet(df: DataFrame, c: str | Column, name: str = "value", limit: int | None = 1000) -> DataFrame:
    """The same for the elements of an array."""
    return facet(df.select(F.explode(c).alias(name)), name, name, limit)


def category_facet(scores: DataFrame) -> DataFrame:
    """The values of each categorical score."""
    rows = scores.where((F.col("data_type") == "CATEGORICAL") & F.col("string_value").isNotNull())
    return rows.groupBy("name").agg(F.array_sort(F.collect_set("string_value")).alias("values"))


def environments(*frames: DataFrame) -> DataFrame:
    """The distinct environments of the frames, and always ``default``."""
    out = frames[0].sparkSession.createDataFrame([("default",)], "environment string")
    for df in frames:
        out = out.unionByName(df.select("environment").where("environment is not null").distinct())
    return out.distinct()


def offset_page(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(page * size).limit(size)


def keyset_page(df: DataFrame, keys: tuple[str, ...], after: tuple | None, size: int) -> DataFrame:
    """The next page in descending order of ``keys`` after a row's keys, and one row more that tells whether there is another."""
    if after is not None:
        below, same = F.lit(False), F.lit(True)
        for k, v in zip(keys, after, strict=True):
            value = F.lit(v).cast(df.schema[k].dataType)
            below = below | (same & (F.col(k) < value))
            same = same & (F.col(k) == value)
        df = df.where(below)
    return df.orderBy(*(F.col(k).desc() for k in keys)).limit(size + 1)


def surrounding(df: DataFrame, time: str, at, n: int, *tie: str) -> DataFrame:
    """The n rows before a time and the n from it on."""
    here = F.lit(at).cast("timestamp_ntz")
    before = df.where(F.col(time) < here).orderBy(F.col(time).desc(), *(F.col(c).desc() for c in tie)).limit(n)
    return before.unionByName(df.where(F.col(time) >= here).orderBy(time, *tie).limit(n))


def capped(spans: DataFrame, trace: str, cap: int = 10_000) -> DataFrame:
    """A trace's first spans, and one more that tells whether there are others."""
    return spans.where(F.col("trace_id") == trace).orderBy("start_time", "span_id").limit(cap + 1)


def exists(df: DataFrame) -> DataFrame:
    """One row: whether the frame has any."""
    return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def page_with_total(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """A page of rows with their number in the whole order and how many there are in all. The total is a count of its own, and the numbers are the page's
    place, so no window runs over all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = offset_page(df, order, page, size)
    numbered = rows.withColumn("row_number", F.row_number().over(Window.orderBy(*order)) + F.lit(page * size))  # over a page's rows
    return numbered.crossJoin(F.broadcast(total))


def default_order(descending: bool = True) -> list[Column]:
    """The order of the trace table where none is asked for: by day, by time, and the newest version first."""
    way = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    return [way(F.to_date("start_time")), way(F.col("start_time")), F.col("event_ts").desc()]


def limited_then_joined(df: DataFrame, order: list[Column], n: int, other: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """The first n rows, joined afterwards: what the join drops is not made up for by later rows."""
    return df.orderBy(*order).limit(n).join(other, on, how)


def any_true(df: DataFrame, flag: str | Column, *keys: str) -> DataFrame:
    """(keys, flag): whether the flag holds on any row of the key."""
    c = F.col(flag) if isinstance(flag, str) else flag
    return df.groupBy(*keys).agg(F.coalesce(F.bool_or(c), F.lit(False)).alias("flag"))


def session_metrics(spans: DataFrame) -> DataFrame:
    """Sessions over all their spans: range, traces, users, tags and cost; arrays are distinct and sorted."""
    rows = spans.where(blank_to_null("session_id").isNotNull())
    return rows.groupBy("project_id", "session_id").agg(
        F.min("start_time").alias("first_at"), F.max("start_time").alias("last_at"), F.array_sort(F.collect_set("trace_id")).alias("trace_ids"), F.array_sort(F.collect_set(blank_to_null("user_id"))).alias("user_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"), F.sum("total_cost").alias("total_cost"))


def since_first(df: DataFrame, time: str, of: DataFrame, of_time: str, slack: str = "1 DAY") -> DataFrame:
    """Rows from a little before the first time of another frame on, by a scalar subquery of one row that the scan is pruned by."""
    first = of.agg((F.min(of_time) - F.expr(f"INTERVAL {slack}")).alias("_first"))
    return df.join(F.broadcast(first), F.col(time) >= F.col("_first")).drop("_first")
