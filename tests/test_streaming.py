"""Streams fed file by file must end where the batch computation ends."""

import time

import pytest
from frames import rows, runs, task, tasks
from pyspark.sql import Window, functions as F

from runmetrics.functions.times import utc
from runmetrics.operators import metrics, results, route_reports, routing
from runmetrics.sources import writers
from runmetrics.streaming import streams

SF = "/root/testdata/sf0.001"
SCHEMA = "event_id long, start_time timestamp, task_type string, status string, duration_ms long"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """The events in time order, spread over five files."""
    from runmetrics.plans import tables

    c = F.col
    rows_ = tables.load(spark, SF, "events").select(
        "event_id", c("ts").alias("start_time"), c("event_type").alias("task_type"),
        F.when(c("event_type") == "error", "failed").otherwise("success").alias("status"), F.round(c("value") * 1000).cast("long").alias("duration_ms"))
    path = str(tmp_path_factory.mktemp("events"))
    for i in range(5):
        rows_.filter((c("event_id") >= i * 200) & (c("event_id") < (i + 1) * 200)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return path


def _stream(spark, path):
    return streams.read_run_stream(spark, path, SCHEMA, max_files=1)


def _batch(spark, path):
    return spark.read.schema(SCHEMA).parquet(path)


def _updates(spark, df, tmp_path, keys):
    query = streams.write_updates(df, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert len({p["batchId"] for p in query.recentProgress if p["numInputRows"]}) == 5
    return streams.read_updates(spark, str(tmp_path / "out"), df.schema, keys)


def test_totals(spark, events, tmp_path):
    out = _updates(spark, streams.stream_totals(_stream(spark, events), ["task_type"]), tmp_path, ["task_type"])
    assert rows(out) == rows(streams.stream_totals(_batch(spark, events), ["task_type"]))


def test_latest(spark, events, tmp_path):
    out = _updates(spark, streams.stream_latest(_stream(spark, events), ["task_type"], ["start_time", "event_id"]), tmp_path, ["task_type"])
    expected = results.latest_per_task(_batch(spark, events), ["start_time", "event_id"], ["task_type"])
    assert rows(out, *expected.columns) == rows(expected)


def test_retain(spark, events, tmp_path):
    out = _updates(spark, streams.stream_retain(_stream(spark, events), 4, ["task_type"], ["start_time", "event_id"]), tmp_path, ["task_type"])
    expected = metrics.retain_last(_batch(spark, events), 4, ["task_type"], ["start_time", "event_id"])
    assert rows(out, "task_type", "event_id") == rows(expected, "task_type", "event_id")


def test_period_rows_are_final(spark, events, tmp_path):
    out = streams.stream_period(_stream(spark, events), "1 day", "1 hour")
    streams.write_append(out, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out"))
    whole = _batch(spark, events).groupBy(F.date_trunc("day", "start_time").alias("period_start")).agg(F.count("*").alias("total"))
    last = whole.agg(F.max("period_start")).first()[0]
    assert rows(done, "period_start", "total") == rows(whole.filter(F.col("period_start") < last))


def test_rate_limits_admit_in_order(spark, events, tmp_path):
    messages = _stream(spark, events).select("event_id", F.col("task_type").alias("channel"), F.col("start_time").alias("generated_at"))
    limits = routing.RateLimits(per_minute=1, per_hour=1, per_day=5)
    out = streams.stream_rate_limit(messages, limits, tie=["event_id"])
    streams.write_append(out, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    used, expected = {}, []
    for e in _batch(spark, events).orderBy("start_time", "event_id").select("event_id", "task_type", F.unix_seconds("start_time").alias("s")).collect():
        slots = [(e.task_type, span, e.s // span) for span, _ in limits.spans()]
        if all(used.get(slot, 0) < limit for slot, (_, limit) in zip(slots, limits.spans())):
            expected.append(e.event_id)
            for slot in slots:
                used[slot] = used.get(slot, 0) + 1
    got = [r.event_id for r in spark.read.parquet(str(tmp_path / "out")).orderBy("event_id").collect()]
    assert got == sorted(expected) and 0 < len(got) < 1000


def test_rate_limit_state_expires_by_event_time(spark, events, tmp_path):
    messages = _stream(spark, events).select("event_id", F.col("task_type").alias("channel"), F.col("start_time").alias("generated_at"))
    limits, held, found = routing.RateLimits(per_minute=1, per_hour=2), {}, {}
    for late in (None, "1 hour"):
        out = streams.stream_rate_limit(messages, limits, tie=["event_id"], late=late)
        query = streams.write_append(out, str(tmp_path / f"out {late}"), str(tmp_path / f"checkpoint {late}"))
        query.awaitTermination()
        held[late] = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
        found[late] = rows(spark.read.parquet(str(tmp_path / f"out {late}")), "event_id")
    assert found[None] == found["1 hour"] and len(found[None]) > 100
    assert held["1 hour"] < held[None] / 10
    with pytest.raises(ValueError, match="not by both"):
        streams.stream_rate_limit(messages, limits, ttl_ms=1, late="1 hour")


def test_state_with_expiry_runs_until_stopped(spark, events, tmp_path):
    latest = streams.stream_latest(_stream(spark, events), ["task_type"], ["start_time", "event_id"], ttl_ms=3_600_000)
    query = streams.write_updates(latest, str(tmp_path / "out"), str(tmp_path / "checkpoint"), available_now=False)
    try:
        end = time.time() + 90
        while time.time() < end and query.exception() is None and sum(p["numInputRows"] for p in query.recentProgress) < 1000:
            time.sleep(0.3)
        assert sum(p["numInputRows"] for p in query.recentProgress) == 1000
    finally:
        query.stop()
    out = streams.read_updates(spark, str(tmp_path / "out"), latest.schema, ["task_type"])
    expected = results.latest_per_task(_batch(spark, events), ["start_time", "event_id"], ["task_type"])
    assert rows(out, "task_type", "event_id") == rows(expected, "task_type", "event_id")


def test_fan_out_writes_every_batch_everywhere(spark, events, tmp_path):
    query = streams.stream_fan_out(
        _stream(spark, events).select("event_id", "task_type"), [("json", str(tmp_path / "j")), ("parquet", str(tmp_path / "p"))], str(tmp_path / "c"))
    query.awaitTermination()
    assert spark.read.json(str(tmp_path / "j")).count() == 1000 == spark.read.parquet(str(tmp_path / "p")).count()


def test_failures_and_run_reports(spark, tmp_path):
    t = tasks(spark, [task("r", "a", "failed", error="E"), task("r", "b", "success")])
    t.write.parquet(str(tmp_path / "t"))
    stream = streams.read_run_stream(spark, str(tmp_path / "t"), t.schema)
    streams.write_append(streams.stream_failures(stream), str(tmp_path / "o1"), str(tmp_path / "c1")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "o1")), "task_id") == [("a",)]
    nested = runs(spark, "r").drop("status").join(
        t.groupBy("run_id").agg(F.collect_list(F.struct("task_id", "task_type", "status", "error")).alias("tasks")), "run_id").withColumn("status", F.lit("partial_success"))
    nested.write.parquet(str(tmp_path / "n"))
    route = routing.Route("all", trigger_on_workflow_completion=True)
    made = streams.stream_run_reports(streams.read_run_stream(spark, str(tmp_path / "n"), nested.schema), [route])
    streams.write_append(made, str(tmp_path / "o2"), str(tmp_path / "c2")).awaitTermination()
    assert "- a (command): E\n" in spark.read.parquet(str(tmp_path / "o2")).first().content
    routes = [route, routing.Route("long", "detailed", trigger_on_workflow_completion=True)]
    made = streams.stream_run_reports(streams.read_run_stream(spark, str(tmp_path / "n"), nested.schema), routes)
    streams.write_append(made, str(tmp_path / "o3"), str(tmp_path / "c3")).awaitTermination()
    found = {r.route: (r.title, r.content) for r in spark.read.parquet(str(tmp_path / "o3")).collect()}
    assert found["all"][0].startswith("Workflow Summary") and found["long"][0].startswith("Detailed Workflow Report")
    assert "- **Total Tasks:** 2\n" in found["long"][1] and " a (command)\n" in found["long"][1] and " b (command)\n" in found["long"][1]


def test_run_reports_read_template_files_and_obey_switches(spark, tmp_path):
    t = tasks(spark, [task("r", "a", "failed", error="E"), task("r", "b", "success")])
    nested = runs(spark, "r").drop("status").join(
        t.groupBy("run_id").agg(F.collect_list(F.struct("task_id", "task_type", "status", "error")).alias("tasks")), "run_id").withColumn("status", F.lit("failed"))
    nested.write.parquet(str(tmp_path / "n"))
    route = routing.Route("filed", "template", trigger_on_workflow_completion=True, template_file="run.txt")
    stream = lambda: streams.read_run_stream(spark, str(tmp_path / "n"), nested.schema)
    streams.write_append(streams.stream_run_reports(stream(), [route], read={"run.txt": "run {{ run_id }}"}.get), str(tmp_path / "o1"), str(tmp_path / "c1")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "o1")), "route", "content") == [("filed", "run r")]
    off = streams.stream_run_reports(stream(), [route], read={"run.txt": "x"}.get, switches=routing.Switches(workflow_completion_reports=False))
    streams.write_append(off, str(tmp_path / "o2"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.schema(off.schema).parquet(str(tmp_path / "o2")).count() == 0


def test_task_reports_follow_their_routes(spark, tmp_path):
    made = [task("r", "a", "failed", error="E"), task("r", "b", "success"), task("r", "c", "timeout"), task("r", "d", "cancelled")]
    t = tasks(spark, made).withColumn("workflow_name", F.lit("wf"))
    t.write.parquet(str(tmp_path / "t"))
    routes = [
        routing.Route("text", "template", trigger_on_task_failure=True, template_file="task.txt"),
        routing.Route("late", "detailed", trigger_on_task_failure=True, filters=routing.Filters(task_status=["Timeout"])),
        routing.Route("off", enabled=False, trigger_on_task_failure=True), routing.Route("run", trigger_on_workflow_completion=True),
    ]
    read = {"task.txt": "{{task_id}} {{error}}"}.get
    stream = lambda: streams.read_run_stream(spark, str(tmp_path / "t"), t.schema)
    streams.write_append(streams.stream_task_reports(stream(), routes, utc("2024-05-06"), read=read), str(tmp_path / "o1"), str(tmp_path / "c1")).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "o1"))
    batch = route_reports.report_routes("task", t, routes, at=utc("2024-05-06"), read=read)
    assert rows(streamed, "task_id", "route", "title", "content") == rows(batch, "task_id", "route", "title", "content")
    assert rows(streamed, "task_id", "route") == [("a", "text"), ("c", "late"), ("c", "text"), ("d", "text")]
    off = streams.stream_task_reports(stream(), routes, read=read, switches=routing.Switches(task_completion_reports=False))
    streams.write_append(off, str(tmp_path / "o2"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.schema(off.schema).parquet(str(tmp_path / "o2")).count() == 0
