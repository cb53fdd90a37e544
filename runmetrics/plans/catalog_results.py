"""Catalog: results, predicates, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maps, status as st, text as tx
from ..functions.times import duration_between
from ..operators import output, results, routing
from . import tables as t
from .oracle import add, rounded, sql_ts, ts

# Predicates -----------------------------------------------------------------------------

for _name, _flag, _sql in (
    ("P1_is_successful", lambda: st.is_successful("status"), "status = 'success'"),
    ("P2_is_failed", lambda: st.is_failed("status"), "status in ('failed','timeout','cancelled')"),
    ("P3_is_finished", lambda: st.is_finished("status"), "status not in ('pending','running')"),
    ("P4_can_retry", lambda: st.can_retry("status", "retry_count", 3), "retry_count < 3 and status in ('failed','timeout')"),
):
    add(
        _name,
        lambda spark, sf, flag=_flag: t.task_runs(spark, sf, False).select("run_id", "task_id", flag().alias("flag")),
        f"select run_id, task_id, {_sql} as flag from tasks", ("tasks",),
    )

_CAMEL = ("Success", "Failed", "PartialSuccess", "Cancelled", "Timeout", "Running")
_SNAKE = "['success','failed','partial_success','cancelled','timeout','running']"

add(
    "P5_normalize_status",
    lambda spark, sf: t.load(spark, sf, "orders").select(
        "o_orderkey",
        st.normalize_status(
            F.element_at(F.array(*[F.lit(s) for s in _CAMEL]), (F.col("o_custkey") % 6 + 1).cast("int"))
        ).alias("status"),
    ),
    f"select o_orderkey, ({_SNAKE})[o_custkey % 6 + 1] as status from orders",
)
add(
    "P6_duration",
    lambda spark, sf: t.runs(spark, sf).select(
        "run_id", duration_between("start_time", "end_time").alias("forward_ms"),
        duration_between("end_time", "start_time").alias("clamped_ms"),
    ),
    """select run_id, epoch_ms(end_time) - epoch_ms(start_time) as forward_ms,
              greatest(0, epoch_ms(start_time) - epoch_ms(end_time)) + (case when end_time is null then null else 0 end) as clamped_ms
       from runs""",
    ("runs",),
)


def _projected(spark, sf):
    options = output.OutputOptions(
        include_metadata=True, include_timestamps=True, include_duration=True, filter_successful=True,
        filter_failed=True, max_output_length=10,
    )
    rows = output.project_runs(t.nested_runs(spark, sf), options)
    task = F.explode_outer("tasks").alias("task")
    return rows.select(
        "workflow_name", "run_id", "start_time", "duration_seconds", "summary.total_tasks", "summary.failed_tasks",
        F.round("summary.success_rate", 6).alias("success_rate"), F.element_at("metadata", "priority").alias("priority"), task,
    ).select(
        "workflow_name", "run_id", "start_time", "duration_seconds", "total_tasks", "failed_tasks", "success_rate", "priority",
        "task.task_id", "task.status", F.col("task.duration_seconds").alias("task_seconds"), "task.output", "task.error",
        "task.retry_count",
    )


add(
    "P7_project_runs", _projected,
    f"""select n.workflow_name, n.run_id, concat(strftime(n.start_time, '%Y-%m-%dT%H:%M:%S.000'), 'Z') as start_time,
              n.duration_ms / 1000.0::double as duration_seconds, s.total_tasks, s.failed_tasks, s.success_rate,
              n.o_orderpriority as priority, k.task_id, k.status, k.duration_ms / 1000.0::double as task_seconds,
              case when k.output is not null then concat(substring(k.output, 1, 10), '... [truncated]') end as output, k.error,
              nullif(k.retry_count, 0) as retry_count
       from nested n
       join (select n.run_id, count(x.task_id) as total_tasks, count(*) filter (x.status in ('failed','timeout')) as failed_tasks,
                    case when count(x.task_id) > 0 then round(cast(count(*) filter (x.status = 'success') as double)
                         / count(x.task_id) * 100, 6) else 0.0 end as success_rate
             from nested n left join nested_tasks x on x.run_id = n.run_id group by n.run_id) s on s.run_id = n.run_id
       left join (select * from nested_tasks where status in ('success','failed','timeout','cancelled')) k on k.run_id = n.run_id""",
    ("nested", "nested_tasks"),
)
add(
    "P8_filter_by_outcome",
    lambda spark, sf: routing.filter_tasks_by_outcome(t.task_runs(spark, sf, False), successful=True, failed=True)
    .select("run_id", "task_id", "status"),
    "select run_id, task_id, status from tasks where status in ('success','failed','timeout','cancelled')", ("tasks",),
)
add(
    "P9_apply_filters",
    lambda spark, sf: routing.apply_filters(
        results.explode_tasks(t.nested_runs(spark, sf)),
        routing.Filters(task_status=["Failed", "Success", "Cancelled"], task_types=["1-URGENT", "2-HIGH", "5-LOW"],
                        min_duration_seconds=5, max_duration_seconds=40, tags={"exit_code": "2"}),
    ).select("run_id", "task_id", "status"),
    """select run_id, task_id, status from nested_tasks
       where status in ('failed','success','cancelled') and task_type in ('1-URGENT','2-HIGH','5-LOW')
         and (duration_ms is null or (duration_ms // 1000 >= 5 and duration_ms // 1000 <= 40)) and exit_code = '2'""",
    ("nested_tasks",),
)

ROUTES = (
    routing.Route("all runs", trigger_on_workflow_completion=True, channels=(routing.Channel("file", "/reports"), routing.Channel("email", "ops", enabled=False))),
    routing.Route("broken runs", "detailed", trigger_on_workflow_completion=True, period="daily",
                  filters=routing.Filters(workflow_status=["Failed", "PartialSuccess"], workflow_names=["wf_1", "wf_2", "wf_3"]),
                  channels=(routing.Channel("slack", "#ops"), routing.Channel("file", "/broken"))),
    routing.Route("switched off", enabled=False, trigger_on_workflow_completion=True, trigger_on_task_failure=True),
    routing.Route("task failures", trigger_on_task_failure=True, period="hourly",
                  filters=routing.Filters(task_types=["ECONOMY", "PROMO"]), channels=(routing.Channel("terminal"),)),
    routing.Route("timeouts", trigger_on_task_failure=True, period="daily", filters=routing.Filters(task_status=["Timeout"]),
                  channels=(routing.Channel("email", "oncall"),)),
)

add(
    "P10_runs_triggering",
    lambda spark, sf: routing.runs_triggering(t.facts(spark, sf), ROUTES).select("run_id", "workflow_name", "status", "route"),
    """select run_id, workflow_name, status, 'all runs' as route from facts
       union all select run_id, workflow_name, status, 'broken runs' from facts
       where status in ('failed','partial_success') and workflow_name in ('wf_1','wf_2','wf_3')""",
    ("facts",),
)
add(
    "P11_tasks_triggering",
    lambda spark, sf: routing.tasks_triggering(t.task_runs(spark, sf), ROUTES).select("run_id", "task_id", "status", "route"),
    """select run_id, task_id, status, 'task failures' as route from typed_tasks
       where status in ('failed','timeout','cancelled') and task_type in ('ECONOMY','PROMO')
       union all select run_id, task_id, status, 'timeouts' from typed_tasks where status = 'timeout'""",
    ("typed_tasks",),
)
add(
    "P12_reportable_tasks",
    lambda spark, sf: routing.reportable_tasks(t.task_runs(spark, sf, False)).select("run_id", "task_id", "error"),
    "select run_id, task_id, error from tasks where status in ('failed','timeout','cancelled')", ("tasks",),
)
add(
    "P15_exit_code_ok",
    lambda spark, sf: results.explode_tasks(t.nested_runs(spark, sf)).select(
        "run_id", "task_id", st.exit_code_ok("metadata", [0, 2]).alias("accepted"),
        st.exit_code_ok(F.map_filter("metadata", lambda k, v: v != "1"), [-1, 0]).alias("missing_is_minus_one"),
        st.exit_code_ok("metadata").alias("any_code"),
    ),
    """select run_id, task_id, exit_code in ('0','2') as accepted, exit_code in ('0','1') as missing_is_minus_one, true as any_code
       from nested_tasks""",
    ("nested_tasks",),
)
add(
    "P17_exclude_globs",
    lambda spark, sf: _exclude(spark, sf),
    r"""select page_id from pages
       where not (regexp_full_match(regexp_extract(url, '[^/]*$'), '[^/]*\.html')
                  or regexp_full_match(url, '(?s)https://.*[?].*') or regexp_full_match(url, '[^/]*\.html')
                  or regexp_full_match(regexp_extract(url, '[^/]*$'), '[0-9][^/]*#[^/]*')
                  or regexp_full_match(url, '[0-9][^/]*#[^/]*')
                  or regexp_full_match(regexp_extract(url, '[^/]*$'), 'https://.*[?].*'))""",
)


def _exclude(spark, sf):
    from ..operators.integrity import exclude_globs

    pages = t.load(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    return exclude_globs(pages, ["*.html", "https://**[?]**", "[0-9]*#*"]).select("page_id")


add(
    "P18_combine_streams",
    lambda spark, sf: t.load(spark, sf, "conversations").select(
        "conv_id", "turn",
        tx.combine_streams(
            F.when(F.col("role") != "user", F.col("text")), F.when(F.col("role") != "assistant", F.col("text")).otherwise("")
        ).alias("output"),
        tx.combine_streams(F.lit(""), F.lit(None).cast("string")).alias("nothing"),
    ),
    """select conv_id, turn, case role when 'user' then concat('STDERR:' || chr(10), text) when 'assistant' then text
              else concat('STDOUT:' || chr(10), text, chr(10) || 'STDERR:' || chr(10), text) end as output,
              cast(null as varchar) as nothing
       from conversations""",
)
add(
    "P19_truncate_text",
    lambda spark, sf: t.load(spark, sf, "documents").select(
        "doc_id", tx.truncate_text("text", 200).alias("short"), F.length(tx.truncate_text("text", 1500, tx.MESSAGE_MARKER)).alias("message_length"),
    ),
    """select doc_id, case when length(text) > 200 then concat(substring(text, 1, 200), '...') else text end as short,
              cast(case when length(text) > 1500 then 1500 + 26 else length(text) end as int) as message_length
       from documents""",
)
add(
    "P20_apply_when",
    lambda spark, sf: results.apply_when(
        t.task_runs(spark, sf, False),
        {"task_2": "retry_count > 3", "task_4": "duration_ms >= 20000", "task_6": "status = 'success' and l_suppkey % 3 = 1"},
    ).select("run_id", "task_id", "status", "error"),
    """select run_id, task_id, case when ok then status else 'skipped' end as status,
              case when ok then error else 'Condition not met' end as error
       from (select *, coalesce(case task_id when 'task_2' then retry_count > 3 when 'task_4' then duration_ms >= 20000
                       when 'task_6' then status = 'success' and l_suppkey % 3 = 1 else true end, false) as ok from tasks) x""",
    ("tasks",),
)


def _conditions(spark, sf):
    def when(field, comparison, value):
        return F.struct(F.lit(field).alias("field"), F.lit(comparison).alias("comparison"), value.alias("value"))

    n, number = F.col("ordinal"), F.substring("workflow_name", 4, 9).cast("long")
    made = t.workflow_tasks(spark, sf).withColumn(
        "when",
        F.when(n == 2, when("retry_count", ">", F.lit("2"))).when(n == 3, when("nobody", "=", F.lit("1")))
        .when(n == 4, when("duration_ms", ">=", (number * 600).cast("string"))).when(n == 6, when("status", "!=", F.lit("success"))))
    named = t.named_tasks(spark, sf, False)
    return results.apply_conditions(named, made, ["retry_count", "duration_ms", "status"]).select("run_id", "task_id", "status", "error")


add(
    "P20_apply_conditions", _conditions,
    """select run_id, task_id, case when ok then status else 'skipped' end as status,
              case when ok then error else 'Condition not met' end as error
       from (select *, coalesce(case task_id when 'task_2' then retry_count > 2 when 'task_3' then false
                       when 'task_4' then duration_ms >= cast(substr(workflow_name, 4) as bigint) * 600
                       when 'task_6' then status <> 'success' else true end, false) as ok from named_tasks) x""",
    ("named_tasks",),
)
add(
    "P21_critical_runs",
    lambda spark, sf: results.critical_runs(t.named_tasks(spark, sf, False), t.workflow_tasks(spark, sf)),
    """select t.run_id, count(*) filter (status in ('failed','timeout','cancelled')) as failed_or_cancelled,
              count(*) filter (status in ('failed','timeout','cancelled') and (required or t.workflow_name like '%3')) as critical_tasks,
              count(*) filter (status in ('failed','timeout','cancelled') and (required or t.workflow_name like '%3')) > 0 as must_stop
       from named_tasks t join definitions d on d.workflow_name = t.workflow_name and d.task_id = t.task_id
       group by t.run_id""",
    ("named_tasks", "definitions"),
)

# Joins ----------------------------------------------------------------------------------

add(
    "J1_with_definition",
    lambda spark, sf: results.with_definition(
        t.named_tasks(spark, sf, False).select("run_id", "workflow_name", "task_id", "status"), t.workflow_tasks(spark, sf)
    ).select("run_id", "task_id", "status", "task_type", "required", "max_attempts"),
    """select t.run_id, t.task_id, t.status, d.task_type, d.required, d.max_attempts
       from named_tasks t join definitions d on d.workflow_name = t.workflow_name and d.task_id = t.task_id""",
    ("named_tasks", "definitions"),
)
_FILLED = """select t.run_id, t.workflow_name, t.task_id, t.task_type, t.status, t.error from named_typed t
       union all
       select r.run_id, r.workflow_name, d.task_id, d.task_type, 'skipped', 'Dependencies failed'
       from runs r join definitions d on d.workflow_name = r.workflow_name
       where not exists (select 1 from typed_tasks t where t.run_id = r.run_id and t.task_id = d.task_id)"""
add(
    "J2_fill_skipped",
    lambda spark, sf: results.fill_skipped(t.runs(spark, sf), t.named_tasks(spark, sf), t.workflow_tasks(spark, sf)),
    _FILLED, ("runs", "named_typed", "definitions"),
)
add(
    "U1_executed_and_skipped",
    lambda spark, sf: results.run_summary(
        results.fill_skipped(t.runs(spark, sf), t.named_tasks(spark, sf), t.workflow_tasks(spark, sf))
    ).select("run_id", "total_tasks", "skipped_tasks", *rounded("success_rate")),
    f"""select run_id, count(*) as total_tasks, count(*) filter (status = 'skipped') as skipped_tasks,
              round(cast(count(*) filter (status = 'success') as double) / count(*) * 100, 6) as success_rate
       from ({_FILLED}) f group by run_id""",
    ("runs", "named_typed", "definitions"),
)
add(
    "J4_dependencies_met",
    lambda spark, sf: results.dependencies_met(
        t.task_runs(spark, sf, False).select("run_id", F.col("ordinal").alias("task_id"), "status"), t.edges(spark, sf)
    ).select("run_id", "task_id", "dependencies_met"),
    """select t.run_id, t.ordinal as task_id,
              coalesce(bool_and(case when e.src is null then null else coalesce(s.status = 'success', false) end), true) as dependencies_met
       from tasks t left join edges e on e.run_id = t.run_id and e.dst = t.ordinal
       left join tasks s on s.run_id = e.run_id and s.ordinal = e.src
       group by t.run_id, t.ordinal""",
    ("tasks", "edges"),
)
for _name in ("J5_latest_per_task", "W3_latest_state"):
    add(
        _name,
        lambda spark, sf: t.task_runs(spark, sf).select(
            "run_id", "task_id", "task_type", "status", ts("start_time").alias("start_time"), "duration_ms", "retry_count", "error"
        ),
        f"select run_id, task_id, task_type, status, {sql_ts('start_time')} as start_time, duration_ms, retry_count, error from typed_tasks",
        ("typed_tasks",),
    )
add(
    "J6_task_facts",
    lambda spark, sf: results.task_facts(t.runs(spark, sf), t.task_runs(spark, sf)).select(
        "run_id", "workflow_name", "task_id", "task_type", "status", "error"
    ),
    "select run_id, workflow_name, task_id, task_type, status, error from named_typed", ("named_typed",),
)
add(
    "J6_explode_tasks",
    lambda spark, sf: results.explode_tasks(t.nested_runs(spark, sf)).select(
        "run_id", "workflow_name", "ordinal", "task_id", "status", "duration_ms", F.element_at("metadata", "exit_code").alias("exit_code")
    ),
    "select run_id, workflow_name, ordinal, task_id, status, duration_ms, exit_code from nested_tasks", ("nested_tasks",),
)


def _routed(spark, sf):
    triggered = routing.runs_triggering(t.facts(spark, sf), ROUTES)
    return routing.route_reports(triggered.select("run_id", "route"), ROUTES)


add(
    "J8_route_reports", _routed,
    """select run_id, 'all runs' as route, 'file' as channel, '/reports' as target from facts
       union all select run_id, 'broken runs', c[1], c[2]
       from (select run_id, unnest([['slack', '#ops'], ['file', '/broken']]) as c from facts
             where status in ('failed','partial_success') and workflow_name in ('wf_1','wf_2','wf_3')) x""",
    ("facts",),
)

# Summaries ------------------------------------------------------------------------------

add(
    "A1_run_summary",
    lambda spark, sf: results.run_summary(t.task_runs(spark, sf, False)).select(
        "run_id", "total_tasks", "successful_tasks", "failed_tasks", "skipped_tasks", "cancelled_tasks", *rounded("success_rate")
    ),
    """select run_id, total_tasks, successful_tasks, failed_tasks, skipped_tasks, cancelled_tasks,
              round(success_rate, 6) as success_rate from facts where total_tasks > 0""",
    ("facts",),
)
add(
    "A2_run_status",
    lambda spark, sf: results.run_status(t.task_runs(spark, sf, False), t.runs(spark, sf)),
    "select run_id, status from facts", ("facts",),
)
add(
    "D6_run_facts",
    lambda spark, sf: t.facts(spark, sf).select(
        "run_id", "workflow_name", "status", "duration_ms", "total_tasks", "successful_tasks", "failed_tasks", "skipped_tasks",
        "cancelled_tasks", *rounded("success_rate"), ts("start_time").alias("start_time"), ts("end_time").alias("end_time"),
    ),
    f"""select run_id, workflow_name, status, duration_ms, total_tasks, successful_tasks, failed_tasks, skipped_tasks,
              cancelled_tasks, round(success_rate, 6) as success_rate, {sql_ts('start_time')} as start_time,
              {sql_ts('end_time')} as end_time from facts""",
    ("facts",),
)
add(
    "A10_state_counts",
    lambda spark, sf: results.state_counts(results.explode_tasks(t.nested_runs(spark, sf)), ["workflow_name"]),
    """select workflow_name, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'running') as running,
              count(*) filter (status not in ('pending','running')) as completed
       from nested_tasks group by workflow_name""",
    ("nested_tasks",),
)

# Maps -----------------------------------------------------------------------------------


def _merged(spark, sf):
    c = F.col
    nation = t.load(spark, sf, "nation").select(c("n_nationkey").alias("c_nationkey"), "n_name")
    rows = t.load(spark, sf, "customer").join(nation, "c_nationkey")
    merged = maps.merge_maps(
        F.create_map(F.lit("env"), F.lit("dev"), F.lit("owner"), c("c_name")),
        F.create_map(F.lit("env"), c("n_name"), F.lit("region"), F.lit("eu")),
        F.create_map(F.when(c("c_custkey") % 2 == 0, "region").otherwise("zone"), c("c_mktsegment")),
    )
    return rows.select("c_custkey", F.explode(merged).alias("name", "value"))


add(
    "U3_merge_maps", _merged,
    """select c_custkey, unnest(['env','owner','region']) as name,
              unnest([n_name, c_name, case when c_custkey % 2 = 0 then c_mktsegment else 'eu' end]) as value
       from customer join nation on c_nationkey = n_nationkey
       union all select c_custkey, 'zone', c_mktsegment from customer join nation on c_nationkey = n_nationkey where c_custkey % 2 = 1""",
)
