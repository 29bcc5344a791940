"""Edge cases of filters, time series, search, trees, analytics and metrics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spanlight.functions import scalars
from spanlight.operators import datasets, filters, histogram, public_api, search, tables, timeseries, tree
from spanlight.operators import score_analytics as sa
from spanlight.plans import metrics


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(1, None, None, None), (2, "", [], {}), (3, "x", [None], {"k": "v"}), (4, "O'Brien 100%_", ["a"], {"k": "O'x"}), (5, "Übung\\", ["a", "b"], None)], "id int, t string, a array<string>, m map<string, string>")


def test_null_rules(texts):
    no = {"type": "string", "column": "t", "operator": "does not contain", "value": "x"}
    assert ids(texts.where(filters.condition(no, {"t": "t"}))) == [2, 4, 5]
    assert ids(texts.where(filters.condition(no, {"t": "t"}, null_as_empty=True))) == [1, 2, 4, 5]
    assert ids(texts.where(filters.condition({"type": "string", "column": "t", "operator": "contains", "value": "%_"}, {"t": "t"}))) == [4]
    assert ids(texts.where(filters.condition({"type": "stringObject", "column": "m", "operator": "starts with", "value": "O'", "key": "k"}, {"m": "m"}))) == [4]
    some = lambda op, v: ids(texts.where(filters.condition({"type": "arrayOptions", "column": "a", "operator": op, "value": v}, {"a": "a"})))
    assert some("any of", ["a", "b"]) == [4, 5] and some("all of", ["a", "b"]) == [5] and some("any of", []) == [] and some("none of", []) == [1, 2, 3, 4, 5]


def test_filter_errors():
    with pytest.raises(filters.FilterError):
        filters.condition({"type": "string", "column": "nope", "operator": "=", "value": "x"}, {"t": "t"})
    with pytest.raises(filters.FilterError):
        filters.checked({"type": "string", "column": "t", "operator": "resembles", "value": "x"})
    with pytest.raises(filters.FilterError):
        filters.checked({"type": "stringObject", "column": "t", "operator": "=", "value": "x"})


def test_scalars(spark):
    df = spark.createDataFrame([(1, {"Input_Cached": 2, "input": 3, "output": 4}), (2, {}), (3, None)], "id int, u map<string, bigint>")
    assert [r[0] for r in df.select(scalars.key_sum("u", "input").cast("int")).collect()] == [5, 0, None]
    pairs = spark.createDataFrame([(["a", "b"], ["1", "2"])], "n array<string>, v array<string>")
    assert pairs.select(scalars.lookup(F.col("n"), F.col("v"), "b"), scalars.lookup(F.col("n"), F.col("v"), "z")).first()[:] == ("2", None)
    rows = spark.createDataFrame([(1, "x"), (2, ""), (3, None)], "t int, v string")
    assert rows.agg(scalars.latest_non_empty("v", "t")).first()[0] == "x"


def test_granularity_and_gaps(spark):
    start = dt.datetime(2024, 2, 28)
    for hours, name in ((1, "minute"), (2, "hour"), (72, "day"), (1440, "week"), (8760, "month")):
        assert timeseries.auto_granularity(start, start + dt.timedelta(hours=hours)) == name
    df = spark.createDataFrame([(dt.datetime(2024, 2, 29), 5)], "time_dimension timestamp_ntz, n int")
    out = timeseries.fill_gaps(df, start, dt.datetime(2024, 3, 1), "day", ["n"]).orderBy("time_dimension").collect()
    assert [r["n"] for r in out] == [0, 5, 0]
    assert timeseries.fill_gaps(df.limit(0), start, dt.datetime(2024, 3, 1), "day", ["n"]).count() == 0
    months = timeseries.calendar(spark, dt.datetime(2024, 1, 31), dt.datetime(2024, 4, 2), "month").collect()
    assert [r[0].month for r in months] == [1, 2, 3, 4]
    by = spark.createDataFrame([(dt.datetime(2024, 2, 29), None, 5)], "time_dimension timestamp_ntz, d string, n int")
    assert {(r["d"], r["n"]) for r in timeseries.fill_gaps(by, start, dt.datetime(2024, 3, 1), "day", ["n"], ["d"]).collect()} == {(None, 5), (None, None)}


def test_week_begins_on_monday(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 3, 23),), (dt.datetime(2024, 3, 4),)], "t timestamp_ntz")
    assert [r[0].day for r in df.select(timeseries.bucket("t", "week")).collect()] == [26, 4]


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    assert [tuple(r) for r in histogram.binned(df, "x").collect()] == [(0, 5.0, 5.0, 2)]
    assert histogram.binned(df.limit(0), "x").count() == 0


def test_lucene(spark):
    df = spark.createDataFrame([(1, "error in parser", "a", 5), (2, "all fine", "b", 50), (3, None, "c", None)], "id int, text string, tag string, n int")
    parser = search.Lucene({"text": "text", "tag": "tag", "n": "n"}, ["text"])
    find = lambda q: ids(df.where(parser.parse(q)))
    assert find("error") == [1] and find('"in parser"') == [1] and find("NOT error") == [2, 3] and find("tag:a OR tag:b") == [1, 2]
    assert find("n:>10") == [2] and find("n:[1 TO 50]") == [1, 2] and find("unknown:x") == [] and find("-tag:a n:*") == [2] and find("") == [1, 2, 3] and find("pars*") == [1]
    for bad in ("(a", "tag:", "a )"):
        with pytest.raises(ValueError):
            parser.parse(bad)


def test_tree_with_orphans_and_cycles(spark):
    rows = [("r", ""), ("a", "r"), ("b", "a"), ("o", "lost"), ("s", "s"), ("x", "y"), ("y", "x")]
    df = spark.createDataFrame([("p", "t", i, q, 1.0) for i, q in rows], "project_id string, trace_id string, span_id string, parent_span_id string, cost double")
    out = {r["span_id"]: (r["cost"], r["n_descendants"]) for r in tree.rolled_up(df, "cost").collect()}
    assert out["r"] == (3.0, 2) and out["a"] == (2.0, 1) and out["o"] == (1.0, 0) and out["s"] == (1.0, 0) and out["x"] == (2.0, 1) and out["y"] == (2.0, 1)


def test_deep_trees(spark):
    """A chain of 1,000 spans, and a cycle of 100 with a chain of 50 below it."""
    rows = [("t", f"c{i}", f"c{i - 1}" if i else "") for i in range(1000)] + [("u", f"r{i}", f"r{(i + 1) % 100}") for i in range(100)] + [("u", f"d{i}", f"d{i - 1}" if i else "r7") for i in range(50)]
    df = spark.createDataFrame([("p", t, i, q, 1) for t, i, q in rows], "project_id string, trace_id string, span_id string, parent_span_id string, cost bigint")
    out = {r["span_id"]: (r["cost"], r["n_descendants"], r["height"]) for r in tree.rolled_up(df, "cost").collect()}
    assert len(out) == 1150 and all(out[f"c{i}"] == (1000 - i, 999 - i, 999 - i) for i in range(1000))
    assert all(out[f"r{i}"][:2] == (150, 149) for i in range(100)) and all(out[f"d{i}"] == (50 - i, 49 - i, 49 - i) for i in range(50))
    marks = df.where("span_id IN ('c0', 'c500', 'r3')").select("project_id", "trace_id", "span_id", F.col("span_id").alias("m"))
    found = {r["span_id"]: r["m"] for r in tree.propagate(df, marks, "m").collect()}
    assert found["c499"] == "c0" and found["c999"] == "c500" and found["r3"] == "r3" and found["r4"] == "r3" and found["d49"] == "r3" and len(found) == 1150
    assert {r["span_id"] for r in tree.propagate(df, marks.where("m = 'c500'"), "m").collect()} == {f"c{i}" for i in range(500, 1000)}
    short = df.where("trace_id = 't' AND cast(substr(span_id, 2) AS int) < 80")
    assert tree.descendants(short, short.where("span_id = 'c0'")).agg(F.max("distance")).first()[0] == 79


def test_own_cost(spark):
    df = spark.createDataFrame([(1, 5.0, {"input": 1.0}), (2, 0.0, {"input": 1.0, "output": 2.0}), (3, None, {}), (4, None, None)], "id int, total_cost double, cost_details map<string, double>")
    assert [r[0] for r in df.orderBy("id").select(tree.own_cost()).collect()] == [5.0, 3.0, 0.0, 0.0]


def test_score_bins(spark):
    low, high = F.lit(0.0), F.lit(10.0)
    assert spark.createDataFrame([(0.0,), (0.99,), (1.0,), (1.00001,), (9.99,), (10.0,)], "v double").select(histogram.score_bin(F.col("v"), low, high, 10)).toPandas().iloc[:, 0].tolist() == [0, 0, 0, 1, 9, 9]
    assert spark.range(1).select(histogram.score_bin(F.lit(3.0), F.lit(3.0), F.lit(3.0), 10)).first()[0] == 0


def test_bucket_seconds():
    start = dt.datetime(2024, 1, 1)
    assert [timeseries.bucket_seconds(start, start + dt.timedelta(seconds=s)) for s in (50, 250, 60 * 50, 10 * 86400, 60 * 86400)] == [5, 5, 60, 18000, 86400]


def test_constant_scores_have_no_correlation(spark):
    schema = "id string, trace_id string, observation_id string, session_id string, run_id string, value double, string_value string, timestamp timestamp_ntz"
    make = lambda values: spark.createDataFrame([(str(i), str(i), None if i else "", None, None, v, None, dt.datetime(2024, 1, 1)) for i, v in enumerate(values)], schema)
    first, second = make([1.0, 1.0, 1.0]), make([1.0, 2.0, 3.0])
    out = sa.statistics(first, second, sa.matched(first, second)).first()
    assert out["n_matched"] == 3 and out["pearson"] is None and out["spearman"] is None and out["mae"] == 1.0
    ranks = sa.average_ranks(make([3.0, 1.0, 3.0, 2.0]).select("value"), "value", "r").orderBy("value").collect()
    assert [r["r"] for r in ranks] == [1.0, 2.0, 3.5, 3.5]


def test_agreement_of_identical_labels(spark):
    table = spark.createDataFrame([("a", "a", 3), ("b", "b", 1)], "category1 string, category2 string, count bigint")
    assert sa.agreement(table).first()[:] == (4, 1.0, 1.0, 1.0)
    assert sa.agreement(table.limit(0)).count() == 0


def test_versions_carry_forward(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    versions = spark.createDataFrame([("i", 1.0, t(1)), ("i", 2.0, t(5))], "item_id string, payload double, valid_from timestamp_ntz")
    asked = spark.createDataFrame([("i", t(1)), ("i", t(4)), ("i", t(9)), ("j", t(2))], "item_id string, at timestamp_ntz")
    out = datasets.versions_at_runs(versions, asked).orderBy("item_id", "at").collect()
    assert [r["payload"] for r in out] == [1.0, 1.0, 2.0, None]


def test_keyset_pages_meet(spark):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("k"))
    first = tables.keyset_page(df, ("k", "id"), None, 4).collect()
    after = first[3]
    rest = tables.keyset_page(df, ("k", "id"), (after["k"], after["id"]), 10).collect()
    assert len(first) == 5 and first[4] == rest[0] and len(rest) == 6


def test_query_errors(spark):
    base = {"view": "traces", "metrics": [{"measure": "count", "aggregation": "sum"}]}
    for change in ({"view": "x"}, {"metrics": []}, {"dimensions": [{"field": "x"}]}, {"metrics": [{"measure": "uniqueUserIds", "aggregation": "p95"}]}, {"rowLimit": 0}, {"bins": 101}):
        with pytest.raises(metrics.QueryError):
            metrics.validate(base | change)
    with pytest.raises(metrics.QueryError):
        metrics.guard_cardinality(base | {"dimensions": [{"field": "userId"}]})
    metrics.guard_cardinality(base | {"dimensions": [{"field": "userId"}], "rowLimit": 10, "orderBy": [{"field": "sum_count", "direction": "desc"}]})


def test_guard_in_force_and_raw_filters(spark):
    spec = {"view": "traces", "dimensions": [{"field": "userId"}], "metrics": [{"measure": "count", "aggregation": "sum"}]}
    with pytest.raises(metrics.QueryError):
        metrics.compile_query(spec, {})
    df = spark.range(3)
    with pytest.raises(filters.FilterError):
        public_api.raw(df, "id > 1")
    with pytest.raises(filters.FilterError):
        public_api.raw(df, "id > 1; drop table x", trusted=True)
    assert public_api.raw(df, "id > 1", trusted=True).count() == 1 and public_api.raw(df, None).count() == 3
    with pytest.raises(filters.FilterError):
        public_api.field_groups(df, ["nothing"])


def test_widget_order():
    first = {"aggregation": "sum", "measure": "count"}
    assert metrics.widget_order("PIVOT_TABLE", {"column": "c", "order": "ASC"}, True, first) == [{"field": "c", "direction": "asc"}]
    assert metrics.widget_order("BAR", {"column": "c", "order": "ASC"}, True, first) == [{"field": "sum_count", "direction": "desc"}]
    assert metrics.widget_order("BAR", None, False, first) is None
