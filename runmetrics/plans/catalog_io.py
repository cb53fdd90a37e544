"""Catalog: sources, sinks and streams. Files go to a new folder below the shared one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema
from ..functions.times import rfc3339, utc
from ..operators import output, reports, routing
from ..operators.results import explode_tasks
from ..session import configure, shared_dir
from ..sources import readers, writers
from ..streaming import streams
from . import tables as t
from .catalog_results import ROUTES
from .oracle import add, rounded, sql_ts, ts


def scratch(spark: SparkSession) -> str:
    configure(spark)
    return f"{shared_dir(spark).rstrip('/')}/runmetrics-{uuid.uuid4().hex}"


# Run results in both written forms --------------------------------------------------------

_CAMEL = {"success": "Success", "failed": "Failed", "partial_success": "PartialSuccess", "skipped": "Skipped", "timeout": "Timeout",
          "cancelled": "Cancelled", "running": "Running", "pending": "Pending"}


def _camel(status):
    names = F.create_map(*[F.lit(x) for pair in _CAMEL.items() for x in pair])
    return names[status]


def _parts(ms):
    return F.struct(F.floor(ms / 1000).alias("secs"), (ms % 1000 * 1000000).cast("long").alias("nanos"))


def _dumped(nested: DataFrame) -> DataFrame:
    def task(x):
        return x.withField("status", _camel(x["status"])).withField("duration", _parts(x["duration_ms"])).withField(
            "start_time", rfc3339(x["start_time"])).withField("end_time", rfc3339(x["end_time"])).dropFields("duration_ms")

    return nested.select(
        "workflow_name", F.col("run_id").cast("string").alias("run_id"), _camel(F.col("status")).alias("status"),
        rfc3339("start_time").alias("start_time"), rfc3339("end_time").alias("end_time"),
        _parts(F.col("duration_ms")).alias("duration"), F.transform("tasks", task).alias("tasks"), "metadata",
    )


def _formatted(nested: DataFrame) -> DataFrame:
    options = output.OutputOptions(include_metadata=True, include_timestamps=True, include_duration=True)
    return output.project_runs(nested.withColumn("run_id", F.col("run_id").cast("string")), options)


def _read_back(spark, sf, written):
    path = scratch(spark)
    writers.write_json(written(t.nested_runs(spark, sf)), path)
    return readers.read_runs(spark, path, multiline=False)


_FLAT = f"""select cast(run_id as varchar) as run_id, workflow_name, ordinal, task_id, status, duration_ms, retry_count, error, exit_code,
       {sql_ts('start_time')} as start_time from nested_tasks"""


def _flat(runs):
    return explode_tasks(runs).select(
        "run_id", "workflow_name", "ordinal", "task_id", "status", "duration_ms", "retry_count", "error",
        F.element_at("metadata", "exit_code").alias("exit_code"), ts("start_time").alias("start_time"),
    )


add("S1_read_dumped_runs", lambda spark, sf: _flat(_read_back(spark, sf, _dumped)), _FLAT, ("nested_tasks",))
add("S2_read_formatted_runs", lambda spark, sf: _flat(_read_back(spark, sf, _formatted)), _FLAT, ("nested_tasks",))
for _name, _form in (("S3_normalize_dumped", _dumped), ("S3_normalize_formatted", _formatted)):
    add(
        _name,
        lambda spark, sf, form=_form: _read_back(spark, sf, form).select(
            "run_id", "workflow_name", "status", ts("start_time").alias("start_time"), ts("end_time").alias("end_time"),
            "duration_ms", F.element_at("metadata", "priority").alias("priority"), F.size("tasks").alias("tasks"),
        ),
        f"""select cast(run_id as varchar) as run_id, workflow_name, status, {sql_ts('start_time')} as start_time,
              {sql_ts('start_time + to_milliseconds(duration_ms)')} as end_time, duration_ms, o_orderpriority as priority,
              cast(o_custkey % 5 as int) as tasks from nested""",
        ("nested",),
    )


def _definitions(spark, sf):
    c = F.col
    rows = t.load(spark, sf, "customer")

    def task(i):
        name = F.concat(F.lit("task_"), i.cast("string"))
        before = F.concat(F.lit("task_"), (i - 1).cast("string"))
        return F.struct(
            name.alias("task_id"), F.when(i % 2 == 0, F.concat(c("c_mktsegment"), F.lit(" job"))).alias("name"),
            F.lit("command").alias("task_type"), F.when(i > 1, F.array(before)).alias("depends_on"),
            F.when(i == 2, F.lit(False)).alias("required"), F.when(i == 3, c("c_nationkey")).alias("max_attempts"),
        )

    return rows.select(
        c("c_name").alias("workflow_name"), F.lit("file:///out").alias("output_destination"),
        F.transform(F.sequence(F.lit(1), (c("c_custkey") % 4 + 1).cast("int")), task).alias("tasks"),
    )


def _definitions_back(spark, sf):
    path = scratch(spark)
    writers.write_json(_definitions(spark, sf), path)
    return readers.read_definitions(spark, path, multiline=False).select(
        "workflow_name", "ordinal", "task_id", "name", "task_type", F.array_join("depends_on", ",").alias("depends_on"),
        "required", "max_attempts",
    )


for _name in ("S4_read_definitions", "O4_declared_order"):
    add(
        _name, _definitions_back,
        """select c_name as workflow_name, cast(i - 1 as int) as ordinal, concat('task_', cast(i as varchar)) as task_id,
              case when i % 2 = 0 then concat(c_mktsegment, ' job') else concat('task_', cast(i as varchar)) end as name, 'command' as task_type,
              case when i > 1 then concat('task_', cast(i - 1 as varchar)) else '' end as depends_on, i <> 2 as required,
              case when i = 3 then c_nationkey end as max_attempts
       from (select *, unnest(range(1, c_custkey % 4 + 2)) as i from customer) x""",
    )

# Writing ---------------------------------------------------------------------------------


def _json_lines(spark, sf):
    rows = t.facts(spark, sf).select("run_id", "workflow_name", "status", "total_tasks", "duration_ms")
    return rows.select("run_id", writers.json_text(rows).alias("json"), F.length(writers.json_text(rows, pretty=True)).alias("pretty_length"))


add(
    "S7_write_json", _json_lines,
    """select run_id, json, cast(length(json) + 1 + fields * 5 as int) as pretty_length from (
         select run_id, concat('{"run_id":', cast(run_id as varchar), ',"workflow_name":"', workflow_name, '","status":"', status, '","total_tasks":',
           cast(total_tasks as varchar), case when duration_ms is not null then concat(',"duration_ms":', cast(duration_ms as varchar)) else '' end, '}') as json,
           case when duration_ms is not null then 5 else 4 end as fields from facts) x""",
    ("facts",),
)


def _report_files(spark, sf):
    path = scratch(spark)
    made = reports.report_task_summary(t.named_tasks(spark, sf), at=utc("2024-05-06 07:08:09"))
    writers.write_reports(made, path)
    back = spark.read.option("wholetext", False).text(path)
    lines = back.filter("value like '**Workflow:**%' or value like '**Status:**%'")
    return lines.groupBy("report_type", F.col("date").cast("string").alias("date"), "value").agg(F.count("*").alias("lines"))


add(
    "S8_write_reports", _report_files,
    """select 'summary' as report_type, '2024-05-06' as date, value, count(*) as lines from (
         select concat('**Workflow:** ', workflow_name, ' (', cast(run_id as varchar), ')') as value from named_typed
         union all select concat('**Status:** ', status, case when duration_ms is not null
                then concat(' (took ', printf('%.1f', duration_ms / 1000.0::double), 's)') else '' end) from named_typed) x
       group by value""",
    ("named_typed",),
)


def _modes(spark, sf):
    path = scratch(spark)
    nations = t.load(spark, sf, "nation")
    writers.write(nations, f"{path}/a")
    writers.write(nations, f"{path}/a", "append")
    writers.write(nations, f"{path}/b")
    writers.write(nations, f"{path}/b", "overwrite")
    for made in (nations, nations.withColumn("n_name", F.lower("n_name"))):
        writers.write(made, f"{path}/c", keep_previous=True)
    names = ["n_nationkey", "n_name", "n_regionkey"]
    parts = [spark.read.parquet(f"{path}/{n}").select(F.lit(n).alias("folder"), *names, *(["version"] if n == "c" else [F.lit(0).alias("version")])) for n in "abc"]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


add(
    "S9_write_modes", _modes,
    """select folder, n_nationkey, case when version = 2 then lower(n_name) else n_name end as n_name, n_regionkey, version
       from nation, (values ('a', 0), ('a', 0), ('b', 0), ('c', 1), ('c', 2)) w(folder, version)""",
)


def _fanned(spark, sf):
    path = scratch(spark)
    rows = t.facts(spark, sf).select("run_id", "status", "total_tasks")
    writers.fan_out(rows, [("json", f"{path}/json"), ("parquet", f"{path}/parquet"), ("csv", f"{path}/csv")])
    kinds = {"json": spark.read.schema(rows.schema).json(f"{path}/json"), "parquet": spark.read.schema(rows.schema).parquet(f"{path}/parquet"),
             "csv": spark.read.schema(rows.schema).option("header", True).csv(f"{path}/csv")}
    out = None
    for kind, back in kinds.items():
        part = back.select(F.lit(kind).alias("sink"), "*")
        out = part if out is None else out.unionByName(part)
    return out


add(
    "S10_fan_out", _fanned,
    "select sink, run_id, status, total_tasks from facts, (select unnest(['json','parquet','csv']) as sink) s", ("facts",),
)


def _metric_files(spark, sf):
    from ..operators import metrics

    path = scratch(spark)
    rows = metrics.performance_by_workflow(t.facts(spark, sf)).select("workflow_name", "total_runs", "failed_runs", "max_duration_ms")
    for fmt in ("csv", "json", "orc"):
        writers.write_metrics(rows, f"{path}/{fmt}", fmt)
    back = [spark.read.schema(rows.schema).option("header", True).format(f).load(f"{path}/{f}").withColumn("format", F.lit(f)) for f in ("csv", "json", "orc")]
    return back[0].unionByName(back[1]).unionByName(back[2])


add(
    "S11_write_metrics", _metric_files,
    """select workflow_name, count(*) as total_runs, count(*) filter (status = 'failed') as failed_runs, max(duration_ms) as max_duration_ms, format
       from facts, (select unnest(['csv','json','orc']) as format) s group by workflow_name, format""",
    ("facts",),
)
for _name in ("S13_compressed_output", "S14_decompressed_input"):
    add(
        _name,
        lambda spark, sf: _compressed(spark, sf),
        """select codec, suffix, event_id, event_type
       from events, (values ('bzip2', 'bz2'), ('gzip', 'gz'), ('deflate', 'deflate')) c(codec, suffix)""",
    )


def _compressed(spark, sf):
    path = scratch(spark)
    rows = t.load(spark, sf, "events").select("event_id", "event_type")
    out = None
    for codec in ("bzip2", "gzip", "deflate"):
        writers.write(rows, f"{path}/{codec}", fmt="json", compression=codec)
        back = spark.read.schema(rows.schema).json(f"{path}/{codec}")
        suffix = F.element_at(F.split(F.input_file_name(), r"\."), -1)
        part = back.select(F.lit(codec).alias("codec"), suffix.alias("suffix"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def _sunk(spark, sf):
    path = scratch(spark)
    writers.register_sink("orc", lambda df, target: df.write.mode("overwrite").orc(target))
    writers.fan_out(t.runs(spark, sf).select("run_id", "workflow_name"), [("orc", path)])
    return spark.read.schema("run_id long, workflow_name string").orc(path)


add("X3_register_sink", _sunk, "select run_id, workflow_name from runs", ("runs",))

# Streams ---------------------------------------------------------------------------------


def _completions(spark, sf):
    configure(spark)
    events = streams.read_run_stream(spark, sf, t.SCHEMAS["events"], glob="events.parquet")
    c = F.col
    return events.select(
        c("event_id"), c("user_id").cast("string").alias("run_id"), c("event_type").alias("task_type"), c("ts").alias("start_time"),
        F.when(c("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.round(c("value") * 1000).cast("long").alias("duration_ms"),
    )


def _appended(spark, df):
    path = scratch(spark)
    streams.write_append(df, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def _updated(spark, df, keys=()):
    path = scratch(spark)
    streams.write_updates(df, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return streams.read_updates(spark, f"{path}/out", df.schema, keys)


add(
    "S6_read_run_stream",
    lambda spark, sf: _appended(spark, _completions(spark, sf)).select("event_id", "run_id", "task_type", "status", "duration_ms"),
    "select event_id, run_id, task_type, status, duration_ms from stream_events", ("stream_events",),
)
add(
    "T1_stream_totals",
    lambda spark, sf: _updated(spark, streams.stream_totals(_completions(spark, sf), ["task_type"]), ["task_type"]).select(
        "task_type", "total", "successful", "failed", *rounded("success_rate")
    ),
    """select task_type, count(*) as total, count(*) filter (status = 'success') as successful, count(*) filter (status = 'failed') as failed,
              round(cast(count(*) filter (status = 'success') as double) / count(*) * 100, 6) as success_rate
       from stream_events group by task_type""",
    ("stream_events",),
)
add(
    "T2_stream_period",
    lambda spark, sf: _appended(spark, streams.stream_period(_completions(spark, sf), "1 hour", "10 minutes")).select(
        ts("period_start").alias("period_start"), ts("period_end").alias("period_end"), "total", "successful", "failed",
        *rounded("avg_duration_ms", "success_rate"),
    ),
    f"""select {sql_ts('p')} as period_start, {sql_ts('p + interval 1 hour')} as period_end, count(*) as total,
              count(*) filter (status = 'success') as successful, count(*) filter (status = 'failed') as failed,
              round(avg(duration_ms), 6) as avg_duration_ms,
              round(cast(count(*) filter (status = 'success') as double) / count(*) * 100, 6) as success_rate
       from (select *, date_trunc('hour', start_time) as p from stream_events) x
       group by p having p + interval 1 hour <= (select max(start_time) from stream_events) - interval 10 minute""",
    ("stream_events",),
)
_NEWEST = """select run_id, task_type, event_id, status, duration_ms from (
         select *, row_number() over (partition by run_id, task_type order by start_time desc, event_id desc) as rn from stream_events) x
       where rn = 1"""
add(
    "T3_stream_latest",
    lambda spark, sf: _updated(
        spark, streams.stream_latest(_completions(spark, sf), ["run_id", "task_type"], ["start_time", "event_id"]), ["run_id", "task_type"]
    ).select("run_id", "task_type", "event_id", "status", "duration_ms"),
    _NEWEST, ("stream_events",),
)
add(
    "T3_stream_distinct",
    lambda spark, sf: _appended(
        spark, streams.stream_distinct(_completions(spark, sf), ["run_id", "task_type", "status"], watermark="40 days")
    ).select("run_id", "task_type", "status"),
    "select distinct run_id, task_type, status from stream_events", ("stream_events",),
)
add(
    "T4_stream_retain",
    lambda spark, sf: _updated(
        spark, streams.stream_retain(_completions(spark, sf), 3, ["task_type"], ["start_time", "event_id"]), ["task_type"]
    ).select("task_type", "event_id", "position"),
    """select task_type, event_id, cast(rn as int) as position from (
         select *, row_number() over (partition by task_type order by start_time desc, event_id desc) as rn from stream_events) x
       where rn <= 3""",
    ("stream_events",),
)


def _failed(spark, sf):
    tasks = _completions(spark, sf).select(
        "run_id", F.col("event_id").cast("string").alias("task_id"), "task_type", F.lit("events").alias("workflow_name"), "status",
        "start_time", "duration_ms", F.lit(0).alias("retry_count"),
    )
    return _appended(spark, streams.stream_failures(tasks, at=utc("2024-05-06"))).select("task_id", "title", F.length("content").alias("length"))


add(
    "T5_stream_failures", _failed,
    """select cast(event_id as varchar) as task_id, concat('Task Summary: ', cast(event_id as varchar), ' in events - failed') as title,
              cast(length(concat('❌ **Task Summary**', '12', '**Task:** ', cast(event_id as varchar), '1', '**Type:** ', task_type, '1', '**Workflow:** events (',
                run_id, ')', '1', '**Status:** failed', ' (took ', printf('%.1f', duration_ms / 1000.0::double), 's)', '1', '**Started:** ',
                '2024-01-01 00:00:00 UTC', '1')) as int) as length
       from stream_events where status = 'failed'""",
    ("stream_events",),
)


TASK_ROUTES = (
    routing.Route("alerts", "template", trigger_on_task_failure=True, variables={"team": "data"},
                  template_content="{{team}} {{upper task_type}} {{task_id}} {{status}} {{task.duration_ms}}"),
    routing.Route("slow", "summary", trigger_on_task_failure=True, filters=routing.Filters(min_duration_seconds=100)),
    routing.Route("late", "detailed", trigger_on_task_failure=True, filters=routing.Filters(task_status=["Timeout"])),
    routing.Route("off", "summary", enabled=False, trigger_on_task_failure=True),
)


def _task_reports(spark, sf):
    c = F.col
    slow = c("duration_ms") > 300_000
    tasks = _completions(spark, sf).select(
        "run_id", c("event_id").cast("string").alias("task_id"), "task_type", F.lit("events").alias("workflow_name"),
        F.when((c("status") == "failed") & slow, "timeout").otherwise(c("status")).alias("status"), "start_time",
        F.lit(None).cast("timestamp").alias("end_time"), "duration_ms", F.lit(0).alias("retry_count"),
        F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("output"),
    )
    made = streams.stream_task_reports(tasks, TASK_ROUTES, utc("2024-05-06"))
    return _appended(spark, made).select("run_id", "task_id", "route", "report_type", "title", F.when(F.col("route") == "alerts", F.col("content")).alias("content"))


add(
    "T5_stream_task_route_reports", _task_reports,
    """select * from (with f as (select run_id, cast(event_id as varchar) as task_id, task_type, duration_ms,
                case when duration_ms > 300000 then 'timeout' else 'failed' end as status from stream_events where status = 'failed')
       select run_id, task_id, 'alerts' as route, 'template' as report_type, concat('alerts - events - Task ', status, ' Report') as title,
              concat('data ', upper(task_type), ' ', task_id, ' ', status, ' ', coalesce(cast(duration_ms as varchar), '')) as content from f
       union all select run_id, task_id, 'slow', 'summary', concat('Task Summary: ', task_id, ' in events - ', status), null from f
       where coalesce(duration_ms // 1000 >= 100, true)
       union all select run_id, task_id, 'late', 'detailed', concat('Detailed Task Report: ', task_id, ' in events - timeout'), null from f
       where status = 'timeout') x""",
    ("stream_events",),
)


def _run_reports(spark, sf):
    configure(spark)
    orders = streams.read_run_stream(spark, sf, t.SCHEMAS["orders"], glob="orders.parquet")
    made = streams.stream_run_reports(t.nested_runs_of(orders), ROUTES, at=utc("2024-05-06"))
    return _appended(spark, made).select(
        "run_id", "route", "title", F.regexp_extract("content", r"- (?:Total|\*\*Total Tasks):(?:\*\*)? (\d+)", 1).alias("total"),
        F.size(F.split("content", r"\n(?:- |### \S+ )task_")).alias("shown"),
    )


add(
    "T6_stream_run_reports", _run_reports,
    """select n.run_id, r.route,
              concat(case r.route when 'broken runs' then 'Detailed Workflow Report: ' else 'Workflow Summary: ' end, workflow_name, ' - ', n.status) as title,
              cast(o_custkey % 5 as varchar) as total,
              cast(1 + case r.route when 'broken runs' then o_custkey % 5 else coalesce(failed, 0) end as int) as shown
       from nested n
       join (select run_id, 'all runs' as route from nested union all select run_id, 'broken runs' from nested
             where status in ('failed','partial_success') and workflow_name in ('wf_1','wf_2','wf_3')) r on r.run_id = n.run_id
       left join (select run_id, count(*) filter (status in ('failed','timeout','cancelled')) as failed from nested_tasks group by run_id) f
         on f.run_id = n.run_id""",
    ("nested", "nested_tasks"),
)


def _template_reports(spark, sf):
    configure(spark)
    orders = streams.read_run_stream(spark, sf, t.SCHEMAS["orders"], glob="orders.parquet")
    routes = [
        routing.Route("short", "template", trigger_on_workflow_completion=True, variables={"team": "data"},
                      template_content="{{team}} {{workflow_name}} {{status}} {{workflow.summary.total_tasks}} {{workflow.duration_ms}}"),
        routing.Route("summaries", trigger_on_workflow_completion=True, filters=routing.Filters(workflow_names=["wf_1"])),
    ]
    made = streams.stream_run_reports(t.nested_runs_of(orders), routes, utc("2024-05-06"))
    return _appended(spark, made).select("run_id", "route", "title", F.when(F.col("route") == "short", F.col("content")).alias("content"))


add(
    "T6_stream_template_reports", _template_reports,
    """select run_id, 'short' as route, concat('short - ', workflow_name, ' - Workflow ', status, ' Report') as title,
              concat('data ', workflow_name, ' ', status, ' ', cast(o_custkey % 5 as varchar), ' ', cast(o_custkey % 90 * 60000 as varchar)) as content from nested
       union all
       select run_id, 'summaries', concat('Workflow Summary: ', workflow_name, ' - ', status), null from nested where workflow_name = 'wf_1'""",
    ("nested",),
)


def _stream_fanned(spark, sf):
    path = scratch(spark)
    rows = _completions(spark, sf).select("event_id", "task_type", "status")
    streams.stream_fan_out(rows, [("json", f"{path}/json"), ("parquet", f"{path}/parquet")], f"{path}/checkpoint").awaitTermination()
    a = spark.read.schema(rows.schema).json(f"{path}/json").select("event_id", "task_type", F.lit("json").alias("sink"))
    b = spark.read.schema(rows.schema).parquet(f"{path}/parquet").select("event_id", "task_type", F.lit("parquet").alias("sink"))
    return a.unionByName(b)


add(
    "T7_stream_fan_out", _stream_fanned,
    "select event_id, task_type, sink from stream_events, (select unnest(['json','parquet']) as sink) s", ("stream_events",),
)


def _throttled(spark, sf):
    rows = _completions(spark, sf).select("event_id", F.col("task_type").alias("channel"), F.col("start_time").alias("generated_at"))
    return _appended(
        spark, streams.stream_rate_limit(rows, routing.RateLimits(per_hour=2), tie=["event_id"])
    ).select("event_id", "channel")


add(
    "T8_stream_rate_limit", _throttled,
    """select event_id, task_type as channel from (
         select *, row_number() over (partition by task_type, date_trunc('hour', start_time) order by start_time, event_id) as rn from stream_events) x
       where rn <= 2""",
    ("stream_events",),
)
