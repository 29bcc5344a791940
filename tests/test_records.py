"""Ingestion, sinks, OpenTelemetry and streaming."""

import datetime as dt
import json

from pyspark.sql import functions as F

from spanlight.sources import otel, sinks
from spanlight.streaming import ingest

T = "id string, rank int, timestamp int, seq int, set array<string>, start_time int, end_time int, name string, tags array<string>, metadata map<string, string>"


def test_merge_rules(spark):
    rows = [
        ("a", 1, 5, 1, ["start_time", "end_time", "name", "tags", "metadata"], 9, 1, "late", ["z"], {"k": "2", "n": "1"}),
        ("a", 0, 7, 2, ["start_time", "name", "tags", "metadata"], 3, None, "create", ["b", "a"], {"k": "1"}),
        ("a", 1, 6, 3, ["name", "metadata"], None, None, None, None, {}),
        ("b", 0, 1, 4, ["start_time", "name"], None, None, "only", None, None),
    ]
    out = {r["id"]: r for r in ingest.merged(spark.createDataFrame(rows, T), ["id"]).collect()}
    a, b = out["a"], out["b"]
    assert a["start_time"] == 3 and a["end_time"] == 3  # the first start stays, an earlier end is clamped
    assert a["name"] is None  # a NULL that is set overwrites
    assert a["tags"] == ["a", "b", "z"] and a["metadata"] == {"k": "2", "n": "1"}  # an empty map does not
    assert b["name"] == "only" and b["start_time"] is None and b["tags"] == []


def test_parse_events(spark):
    good = {"id": "1", "type": "trace-create", "timestamp": "2024-01-01T00:00:00Z", "body": {"id": "t"}}
    lines = [json.dumps(good), "{broken", json.dumps(good | {"type": "x"}), json.dumps({k: v for k, v in good.items() if k != "id"}), json.dumps(good | {"body": {}})]
    events, bad = ingest.parse_events(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r["kind"] for r in events.collect()] == ["trace"]
    assert sorted(r["reason"] for r in bad.collect()) == ["no entity", "no id", "not JSON", "unknown type"]


def test_usage_and_tools(spark):
    df = spark.createDataFrame([({"input": 2, "output": 3, "x": -1},), ({"total": 9, "input": 1},), ({},)], "u map<string, bigint>")
    assert [r[0].get("total") for r in df.select(ingest.clean_usage(F.col("u"))).collect()] == [5, 9, None]
    out = spark.createDataFrame([('{"tool_calls":[{"function":{"name":"f"}},{"name":"g"}]}',), ("no json",), (None,)], "o string")
    assert [r[0] for r in out.select(ingest.tool_calls("o")).collect()] == [["f", "g"], [], []]
    meta = spark.createDataFrame([('{"a":{"b":"1"},"c":"2"}',)], "m string")
    assert meta.select(ingest.flat_metadata("m")).first()[0] == {"a.b": "1", "c": "2"}


def test_otel(spark):
    attr = lambda **kv: [{"key": k.replace("__", "."), "value": {"stringValue": v}} for k, v in kv.items()]
    span = {"traceId": "t", "spanId": "s", "name": "n", "startTimeUnixNano": "1700000000123456789", "endTimeUnixNano": "1700000001123456789", "status": {"code": 2}, "attributes": attr(gen_ai__request__model="m", session__id="x") + [{"key": "gen_ai.usage.input_tokens", "value": {"intValue": "7"}}]}
    doc = {"resourceSpans": [{"resource": {"attributes": attr(service__name="svc")}, "scopeSpans": [{"scope": {"name": "lib"}, "spans": [span]}]}]}
    r = otel.read_spans(spark.createDataFrame([(json.dumps(doc),)], "value string")).first()
    assert (r["type"], r["level"], r["provided_model_name"], r["session_id"], r["service"], r["usage_details"], r["parent_span_id"]) == ("GENERATION", "ERROR", "m", "x", "svc", {"input": 7}, "")
    assert r["start_time"].microsecond == 123456


def test_upsert_stream(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()
    day = "2024-01-01"
    write = lambda n, rows: (source / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("id", "day", "v", "n"), r, strict=True))) for r in rows))
    def run():
        events = spark.readStream.schema("id string, day string, v int, n string").json(str(source))
        q = ingest.stream(events, target, str(tmp_path / "check"), lambda df: df, ["id"], "day", lambda df: sinks.latest(df, ["id", "day"], "v"))
        q.awaitTermination(120)
    write("a", [("x", day, 1, "one"), ("y", "2024-01-02", 1, "other")])
    run()
    write("b", [("x", day, 3, "three"), ("x", day, 2, "two")])
    run()
    out = {r["id"]: (r["v"], r["n"]) for r in spark.read.parquet(target).collect()}
    assert out == {"x": (3, "three"), "y": (1, "other")}


def test_tumbling(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T00:0{m}:30", "k": "a"}) for m in (0, 1, 7)))
    events = spark.readStream.schema("ts timestamp, k string").json(str(tmp_path / "in"))
    q = ingest.tumbling(events, "ts", "5 minutes", "10 minutes", "k").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("windows").collect()) == [1, 2]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "p", "a", ["x"]), (2, None, "b", [])], "id int, project_id string, v string, tags array<string>")
    changes = spark.createDataFrame([(1, "new"), (9, "none")], "id int, v string")
    assert [r["v"] for r in sinks.updated(df, changes, ["id"]).orderBy("id").collect()] == ["new", "b"]
    kept, gone = sinks.deleted(df, F.col("project_id") == "p")
    assert kept.count() == 1 and gone.first()[0] == 1
    for kind in ("csv", "json", "jsonl", "parquet"):
        sinks.export(df, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert sinks.window_of(df, "v", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 12), "daily").count() == 0
    assert df.where(sinks.one_of("id", [])).count() == 0 and spark.range(1).select(sinks.literal(float("nan"))).first()[0] is None


def test_otel_values(spark):
    value = {"arrayValue": {"values": [{"stringValue": 'a"b'}, {"doubleValue": 1.5}, {"arrayValue": {"values": [{"boolValue": True}]}}, {"kvlistValue": {"values": [{"key": "k", "value": {"intValue": "3"}}]}}]}}
    span = {"traceId": "t", "spanId": "s", "name": "n", "startTimeUnixNano": "1700000000000000000", "attributes": [{"key": "x", "value": value}, {"key": "any.observation.type", "value": {"stringValue": "agent"}}, {"key": "both", "value": {"stringValue": "span"}}],
            "events": [{"name": "e", "timeUnixNano": "1700000000000000000", "attributes": [{"key": "a", "value": {"intValue": "1"}}]}], "links": [{"traceId": "u", "spanId": "v"}]}
    doc = {"resourceSpans": [{"resource": {"attributes": [{"key": "both", "value": {"stringValue": "resource"}}]}, "scopeSpans": [{"scope": {"name": "lib", "version": "2", "attributes": [{"key": "sc", "value": {"boolValue": False}}]}, "spans": [span]}]}]}
    r = otel.read_spans(spark.createDataFrame([(json.dumps(doc),)], "value string")).first()
    assert json.loads(r["metadata"]["x"]) == ['a"b', 1.5, [True], {"k": 3}] and r["metadata"]["sc"] == "false" and r["metadata"]["both"] == "span"
    assert r["type"] == "AGENT" and r["events"][0]["attributes"] == {"a": "1"} and r["links"][0]["trace_id"] == "u" and r["scope_version"] == "2" and r["end_time"] is None


def test_upsert_without_a_day(spark, tmp_path):
    """A row without a day finds its record by key, or waits, and no other record is lost."""
    path, merge = str(tmp_path / "t"), lambda df: sinks.latest(df, ["id"], "v")
    put = lambda *rows: ingest.upsert(spark, spark.createDataFrame(rows, "id string, day string, v int, n string"), path, ["id"], "day", merge)
    stored = lambda: sorted((r["id"], r["day"], r["v"], r["n"]) for r in spark.read.schema("id string, day string, v int, n string").parquet(path).collect())
    day = "2024-01-01"
    put(("a", day, 1, "x"), ("b", None, 1, "y"))
    put(("a", None, 2, "z"))
    assert sorted(stored(), key=str) == [("a", day, 2, "z"), ("b", None, 1, "y")]
    put(("c", None, 1, "c"), ("c", "2024-01-03", 2, "cc"))
    put(("b", "2024-01-02", 3, "late"))
    assert stored() == [("a", day, 2, "z"), ("b", "2024-01-02", 3, "late"), ("c", "2024-01-03", 2, "cc")]
    assert sinks.delete_where(spark, path, F.col("n") == "late", "day") == 1
    assert [r[0] for r in stored()] == ["a", "c"] and sinks.delete_where(spark, path, F.col("n") == "none", "day") == 0


def test_score_events(spark):
    make = lambda i, **body: json.dumps({"id": str(i), "type": "score-create", "timestamp": "2024-01-01T00:00:00Z", "body": {"id": f"s{i}", "traceId": "t", "name": "n"} | body})
    lines = [make(1, value=0.5, comment="c"), make(2, value="good"), make(3, value=1, dataType="BOOLEAN"), make(4, value="x", dataType="NUMERIC"), make(5, value=True, dataType="BOOLEAN"), make(6, value=7, dataType="CATEGORICAL"), make(7)]
    out = {r["id"]: (r["data_type"], r["value"], r["string_value"], r["comment"]) for r in ingest.scores_of(ingest.parse_events(spark.createDataFrame([(x,) for x in lines], "value string"))[0]).collect()}
    assert out == {"s1": ("NUMERIC", 0.5, None, "c"), "s2": ("CATEGORICAL", None, "good", None), "s3": ("BOOLEAN", 1.0, "True", None), "s5": ("BOOLEAN", 1.0, "True", None), "s6": ("CATEGORICAL", None, "7", None)}


def test_shards_and_models_in_blocks(spark):
    df = spark.range(1000).selectExpr("'p' AS project", "cast(id % 50 AS string) AS entity").withColumn("shard", ingest.shard_of("project", "entity", 8))
    assert df.groupBy("entity").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0 and df.select("shard").distinct().count() > 4
    spans = spark.createDataFrame([("p", f"m{i}") for i in range(20)], "project_id string, provided_model_name string")
    models = spark.createDataFrame([(f"id{i}", None, f"^m{i}$", dt.date(2024, 1, 1)) for i in range(20)] + [("own", "p", "^m7$", dt.date(2020, 1, 1))], "model_id string, project_id string, match_pattern string, start_date date")
    one, many = ({(r["provided_model_name"], r["model_id"]) for r in ingest.match_models(spans, models, block).collect()} for block in (1000, 5))
    assert one == many and ("m7", "own") in one and ("m3", "id3") in one
