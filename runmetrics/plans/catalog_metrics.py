"""Catalog: period filters, metrics, trends, windows, retention, retries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import status as st
from ..functions.times import period_bounds, period_start, utc
from ..operators import metrics, retry, routing
from . import tables as t
from .oracle import ORACLE, QUERIES, add, rounded, sql_ts, ts

# The registered queries look at fixed periods of the data instead of "now".
START, END = "1997-01-01 00:00:00", "1999-01-01 00:00:00"


def _day(text: str):
    return F.lit(text).cast("timestamp")


def _typed_tasks(spark, sf):
    return t.task_runs(spark, sf)


add(
    "P13_routes_for_period",
    lambda spark, sf: _period_routes(spark, sf),
    f"""select {sql_ts("date_trunc('day', start_time)")} as period_start, unnest(['broken runs', 'timeouts']) as route,
              count(*) as runs from runs group by date_trunc('day', start_time)""",
    ("runs",),
)


def _period_routes(spark, sf):
    from .catalog_results import ROUTES

    names = [r.name for r in routing.routes_for_period(ROUTES, "daily")]
    days = t.runs(spark, sf).groupBy(period_start("start_time", "daily").alias("day")).agg(F.count("*").alias("runs"))
    return days.select(ts("day").alias("period_start"), F.explode(F.array(*[F.lit(n) for n in names])).alias("route"), "runs")


add(
    "P14_in_period",
    lambda spark, sf: metrics.in_period(
        t.load(spark, sf, "events").withColumnRenamed("ts", "start_time"), _day("2024-01-10"), _day("2024-01-20")
    ).select("event_id", "user_id", "event_type"),
    """select event_id, user_id, event_type from events
       where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20'""",
)
add(
    "P16_history_by_name",
    lambda spark, sf: metrics.history(t.facts(spark, sf), workflow="wf_7").select(
        "run_id", "status", ts("start_time").alias("start_time"), "total_tasks"
    ),
    f"select run_id, status, {sql_ts('start_time')} as start_time, total_tasks from facts where workflow_name = 'wf_7'", ("facts",),
)
add(
    "O1_newest_first",
    lambda spark, sf: metrics.history(_typed_tasks(spark, sf), task_type="ECONOMY", limit=25, tie=["run_id", "task_id"]).select(
        "run_id", "task_id", ts("start_time").alias("start_time")
    ),
    f"""select run_id, task_id, {sql_ts('start_time')} as start_time from typed_tasks where task_type = 'ECONOMY'
       order by typed_tasks.start_time desc, run_id, task_id limit 25""",
    ("typed_tasks",),
)

_EXECUTION = ("avg_workflow_duration_ms", "avg_task_duration_ms", "workflow_success_rate", "task_success_rate")
_RUN_SIDE = """count(*) as total_workflows, count(*) filter (status = 'success') as successful_workflows,
         count(*) filter (status = 'failed') as failed_workflows, round(avg(duration_ms), 6) as avg_workflow_duration_ms,
         round(case when count(*) > 0 then cast(count(*) filter (status = 'success') as double) / count(*) * 100 else 0 end, 6) as workflow_success_rate"""
_TASK_SIDE = """count(*) as total_tasks, count(*) filter (status = 'success') as successful_tasks,
         count(*) filter (status = 'failed') as failed_tasks, count(*) filter (status = 'skipped') as skipped_tasks,
         count(*) filter (status = 'cancelled') as cancelled_tasks, count(*) filter (status = 'timeout') as timeout_tasks,
         round(avg(duration_ms), 6) as avg_task_duration_ms,
         round(case when count(*) > 0 then cast(count(*) filter (status = 'success') as double) / count(*) * 100 else 0 end, 6) as task_success_rate"""


def _execution(spark, sf):
    out = metrics.execution_metrics(*t.facts_and_tasks(spark, sf, False), _day(START), _day(END))
    plain = [c for c in out.columns if c not in _EXECUTION and not c.startswith("period_")]
    return out.select(*plain, *rounded(*_EXECUTION), ts("period_start").alias("period_start"), ts("period_end").alias("period_end"))


add(
    "A3_execution_metrics", _execution,
    f"""select r.*, t.*, '{START}' as period_start, '{END}' as period_end
       from (select {_RUN_SIDE} from facts where start_time >= timestamp '{START}' and start_time < timestamp '{END}') r,
            (select {_TASK_SIDE} from tasks where start_time >= timestamp '{START}' and start_time < timestamp '{END}') t""",
    ("facts", "tasks"),
)


def _series(spark, sf, period):
    return metrics.period_series(*t.facts_and_tasks(spark, sf, False), period)


def _series_rows(spark, sf, period):
    out = _series(spark, sf, period)
    plain = [c for c in out.columns if c not in _EXECUTION and c != "period_start"]
    return out.select(ts("period_start").alias("period_start"), *plain, *rounded(*_EXECUTION))


def _series_sql(unit: str) -> str:
    counters = ", ".join(
        f"coalesce({c}, 0) as {c}" for c in (
            "total_workflows", "successful_workflows", "failed_workflows", "total_tasks", "successful_tasks", "failed_tasks",
            "skipped_tasks", "cancelled_tasks", "timeout_tasks", "workflow_success_rate", "task_success_rate")
    )
    return f"""select {sql_ts('coalesce(r.p, t.p)')} as period_start, avg_workflow_duration_ms, avg_task_duration_ms, {counters}
       from (select date_trunc('{unit}', start_time) as p, {_RUN_SIDE} from facts group by 1) r
       full join (select date_trunc('{unit}', start_time) as p, {_TASK_SIDE} from tasks group by 1) t on r.p = t.p"""


for _period, _unit in (("daily", "day"), ("monthly", "month")):
    add(
        f"D11_period_series_{_period}", lambda spark, sf, period=_period: _series_rows(spark, sf, period),
        _series_sql(_unit), ("facts", "tasks"),
    )

add(
    "A4_running_totals",
    lambda spark, sf: (
        lambda out: out.select(
            *[c for c in out.columns if not c.endswith("_rate")], *rounded("workflow_success_rate", "task_success_rate")
        )
    )(metrics.running_totals(*t.facts_and_tasks(spark, sf, False))),
    """select r.*, t.* from
         (select count(*) as total_workflows, count(*) filter (status in ('success','partial_success')) as successful_workflows,
                 count(*) filter (status = 'failed') as failed_workflows,
                 round(cast(count(*) filter (status in ('success','partial_success')) as double) / count(*) * 100, 6) as workflow_success_rate
          from facts) r,
         (select count(*) as total_tasks, count(*) filter (status = 'success') as successful_tasks,
                 count(*) filter (status = 'failed') as failed_tasks, count(*) filter (status = 'skipped') as skipped_tasks,
                 count(*) filter (status = 'cancelled') as cancelled_tasks,
                 round(cast(count(*) filter (status = 'success') as double) / count(*) * 100, 6) as task_success_rate
          from tasks) t""",
    ("facts", "tasks"),
)

_BY_WORKFLOW = """select workflow_name, count(*) as total_runs, count(*) filter (status = 'success') as successful_runs,
              count(*) filter (status = 'failed') as failed_runs, round(avg(duration_ms), 6) as avg_duration_ms,
              min(duration_ms) as min_duration_ms, max(duration_ms) as max_duration_ms,
              round(cast(count(*) filter (status = 'success') as double) / count(*) * 100, 6) as success_rate
       from facts {where} group by workflow_name"""
_BY_TYPE = """select task_type, count(*) as total_executions, count(*) filter (status = 'success') as successful_executions,
              count(*) filter (status = 'failed') as failed_executions, round(avg(duration_ms), 6) as avg_duration_ms,
              round(avg(retry_count), 6) as avg_retry_count,
              round(cast(count(*) filter (status = 'success') as double) / count(*) * 100, 6) as success_rate
       from typed_tasks {where} group by task_type"""
_BY_HOUR = f"""select {sql_ts("date_trunc('hour', start_time)")} as hour, count(*) as workflows_started,
              count(end_time) as workflows_completed, cast(sum(total_tasks) as bigint) as tasks_executed,
              round(avg(duration_ms), 6) as avg_workflow_duration_ms
       from facts group by date_trunc('hour', start_time)"""


def _by_workflow(runs):
    out = metrics.performance_by_workflow(runs)
    return out.withColumns({c: F.round(c, 6) for c in ("avg_duration_ms", "success_rate")})


def _by_type(tasks):
    out = metrics.performance_by_task_type(tasks)
    return out.withColumns({c: F.round(c, 6) for c in ("avg_duration_ms", "avg_retry_count", "success_rate")})


add("A5_performance_by_workflow", lambda spark, sf: _by_workflow(t.facts(spark, sf)), _BY_WORKFLOW.format(where=""), ("facts",))
add("A6_performance_by_task_type", lambda spark, sf: _by_type(_typed_tasks(spark, sf)), _BY_TYPE.format(where=""), ("typed_tasks",))
add(
    "A17_metrics_of_subset",
    lambda spark, sf: _by_type(_typed_tasks(spark, sf).filter(F.col("task_type").isin("ECONOMY", "PROMO"))),
    _BY_TYPE.format(where="where task_type in ('ECONOMY','PROMO')"), ("typed_tasks",),
)
for _name in ("A7_hourly_metrics", "O3_hours_ascending"):
    add(
        _name,
        lambda spark, sf: metrics.hourly_metrics(t.facts(spark, sf)).orderBy("hour").select(
            ts("hour").alias("hour"), "workflows_started", "workflows_completed", "tasks_executed", *rounded("avg_workflow_duration_ms")
        ),
        _BY_HOUR, ("facts",),
    )
for _name, _k in (("A8_top_workflows", 10), ("O2_top_by_runs", 3)):
    add(
        _name,
        lambda spark, sf, k=_k: metrics.top_workflows(t.facts(spark, sf), k).select(
            "name", "runs", "total_tasks", ts("last_run").alias("last_run"), *rounded("success_rate", "avg_duration_ms")
        ),
        f"""select workflow_name as name, count(*) as runs, cast(sum(total_tasks) as bigint) as total_tasks,
              {sql_ts('max(start_time)')} as last_run,
              round(cast(count(*) filter (status = 'success') as double) / count(*) * 100, 6) as success_rate,
              round(avg(duration_ms), 6) as avg_duration_ms
       from facts group by workflow_name order by runs desc, name limit {_k}""",
        ("facts",),
    )
add(
    "A9_failure_patterns",
    lambda spark, sf: metrics.failure_patterns(t.task_runs(spark, sf, False)).select(
        "error_type", "count", ts("first_seen").alias("first_seen"), ts("last_seen").alias("last_seen"), *rounded("percentage")
    ),
    f"""select trim(split_part(coalesce(error, 'Unknown error'), ':', 1)) as error_type, count(*) as "count",
              {sql_ts('min(start_time)')} as first_seen, {sql_ts('max(start_time)')} as last_seen,
              round(cast(count(*) as double) / (select count(*) from tasks where status in ('failed','timeout','cancelled')) * 100, 6) as percentage
       from tasks where status in ('failed','timeout','cancelled') group by 1""",
    ("tasks",),
)
add(
    "A13_breakdown",
    lambda spark, sf: (
        lambda out: out.withColumns({c: F.round(c, 6) for c in ("avg_duration_ms", "success_rate", "avg_retry_count")})
    )(metrics.breakdown(*t.facts_and_tasks(spark, sf))),
    f"""select 'workflow' as section, workflow_name as key, total_runs as total, successful_runs as successful, failed_runs as failed,
              avg_duration_ms, success_rate, null::double as avg_retry_count, null::bigint as tasks_executed
       from ({_BY_WORKFLOW.format(where='')}) w
       union all select 'task_type', task_type, total_executions, successful_executions, failed_executions, avg_duration_ms,
              success_rate, avg_retry_count, null from ({_BY_TYPE.format(where='')}) y
       union all select 'hour', hour, workflows_started, workflows_completed, null, avg_workflow_duration_ms, null, null, tasks_executed
       from ({_BY_HOUR}) h""",
    ("facts", "typed_tasks"),
)

# Windows --------------------------------------------------------------------------------

add(
    "W1_retain_last",
    lambda spark, sf: metrics.retain_last(t.facts(spark, sf), 1000, order=["start_time", "run_id"]).select("run_id", "workflow_name"),
    "select run_id, workflow_name from facts order by start_time desc, run_id desc limit 1000", ("facts",),
)
add(
    "W1_retain_last_per_type",
    lambda spark, sf: metrics.retain_last(
        _typed_tasks(spark, sf), 1500, by=["task_type"], order=["start_time", "run_id", "task_id"]
    ).select("task_type", "run_id", "task_id"),
    """select task_type, run_id, task_id from (
         select *, row_number() over (partition by task_type order by start_time desc, run_id desc, task_id desc) as rn
         from typed_tasks) x where rn <= 1500""",
    ("typed_tasks",),
)


def _trends(spark, sf):
    out = metrics.trends(_series(spark, sf, "monthly"), "monthly")
    return out.select(ts("period_start").alias("period_start"), *[c for c in out.columns if c.endswith("_trend")])


def _trend_sql(name: str, lower: bool) -> str:
    good, bad = ("< -0.05", "> 0.05") if lower else ("> 0.05", "< -0.05")
    zero = "degrading" if lower else "improving"
    change = f"(s.{name} - b.{name}) / b.{name}"
    return f"""case when s.{name} is null or b.{name} is null then 'unknown'
                    when b.{name} = 0 and s.{name} = 0 then 'stable' when b.{name} = 0 then '{zero}'
                    when {change} {good} then 'improving' when {change} {bad} then 'degrading' else 'stable' end"""


_MONTHLY = """(select coalesce(r.p, t.p) as p, wd, td, coalesce(sr, 0) as sr, coalesce(n, 0)::double as n from
  (select date_trunc('month', start_time) as p, count(*) as n, avg(duration_ms) as wd,
          cast(count(*) filter (status = 'success') as double) / count(*) * 100 as sr from facts group by 1) r
  full join (select date_trunc('month', start_time) as p, avg(duration_ms) as td from tasks group by 1) t on r.p = t.p)"""
add(
    "W4_trends", _trends,
    f"""select {sql_ts('s.p')} as period_start, {_trend_sql('wd', True)} as workflow_duration_trend,
              {_trend_sql('td', True)} as task_duration_trend, {_trend_sql('sr', False)} as success_rate_trend,
              {_trend_sql('n', False)} as throughput_trend
       from {_MONTHLY} s left join {_MONTHLY} b on b.p = s.p - interval 1 month""",
    ("facts", "tasks"),
)

add(
    "W5_retry_schedule",
    lambda spark, sf: retry.retry_schedule(
        t.named_tasks(spark, sf, False).join(t.workflow_tasks(spark, sf).drop("ordinal"), ["workflow_name", "task_id"]),
        keys=("run_id", "task_id"), max_delay_ms=3000,
    ),
    """select run_id, task_id, attempt, cast(delay_ms as bigint) as delay_ms,
              cast(sum(delay_ms) over (partition by run_id, task_id order by attempt) as bigint) as total_wait_ms
       from (select run_id, task_id, cast(a as int) as attempt,
                    least(floor(coalesce(initial_delay_ms, 1000) * pow(coalesce(backoff_multiplier, 2.0), a)), 3000) as delay_ms
             from (select t.run_id, t.task_id, d.initial_delay_ms, d.backoff_multiplier,
                          unnest(range(0, greatest(coalesce(max_attempts, case when initial_delay_ms is null and backoff_multiplier is null
                                                   then 3 else 1 end) - 1, 0))) as a
                   from named_tasks t join definitions d on d.workflow_name = t.workflow_name and d.task_id = t.task_id) x) y""",
    ("named_tasks", "definitions"),
)
add(
    "F21_backoff_delay",
    lambda spark, sf: _delays(spark, sf),
    """select p_partkey, cast(floor(least(p_size * 10.0::double * pow(1.5::double, p_partkey % 8), 2000)) as bigint) as delay_ms from part""",
)


def _delays(spark, sf):
    from ..functions.times import backoff_delay

    return t.load(spark, sf, "part").select(
        "p_partkey", backoff_delay(F.col("p_partkey") % 8, F.col("p_size") * 10, F.lit(1.5), 2000).alias("delay_ms")
    )


def _profile(spark, sf):
    out = metrics.concurrency_profile(t.named_tasks(spark, sf, False), capacity=40)
    return out.select("workflow_name", "peak_running", "current_running", *rounded("peak_utilization"))


add(
    "W6_concurrency_profile", _profile,
    """select workflow_name, cast(max(running) as bigint) as peak_running, cast(sum(delta) as bigint) as current_running,
              round(cast(max(running) as double) / 40 * 100, 6) as peak_utilization
       from (select *, sum(delta) over (partition by workflow_name order by moment) as running
             from (select workflow_name, moment, sum(d) as delta
                   from (select workflow_name, start_time as moment, 1 as d from named_tasks
                         union all select workflow_name, end_time, -1 from named_tasks where end_time is not null) e
                   group by workflow_name, moment) p) q
       group by workflow_name""",
    ("named_tasks",),
)
add(
    "F27_utilization",
    lambda spark, sf: t.load(spark, sf, "supplier").select(
        "s_suppkey", F.round(st.utilization(F.col("s_suppkey") % 7, F.col("s_nationkey") % 5), 6).alias("percent")
    ),
    """select s_suppkey, case when s_nationkey % 5 > 0 then round(cast(s_suppkey % 7 as double) / (s_nationkey % 5) * 100, 6) else 0.0 end as percent
       from supplier""",
)
add(
    "F31_success_rate",
    lambda spark, sf: t.load(spark, sf, "supplier").select(
        "s_suppkey", F.round(st.success_rate(F.col("s_suppkey") % 3, F.col("s_nationkey") % 4), 6).alias("rate")
    ),
    """select s_suppkey, case when s_nationkey % 4 > 0 then round(cast(s_suppkey % 3 as double) / (s_nationkey % 4) * 100, 6) else 0.0 end as rate
       from supplier""",
)


def _limited(spark, sf, per_key=None):
    reports = t.load(spark, sf, "events").select("event_id", F.col("event_type").alias("channel"), F.col("ts").alias("generated_at"))
    limits = routing.RateLimits(per_minute=1, per_hour=4, per_day=70)
    return routing.rate_limited(reports, limits, per_key=per_key).select("event_id", "channel", "last_60s", "last_3600s", "last_86400s", "allowed")


add(
    "W7_rate_limited", _limited,
    """select event_id, channel, last_60s, last_3600s, last_86400s, last_60s <= 1 and last_3600s <= 4 and last_86400s <= 70 as allowed
       from (select event_id, event_type as channel,
                    count(*) over (partition by event_type order by epoch(date_trunc('second', ts)) range between 59 preceding and current row) as last_60s,
                    count(*) over (partition by event_type order by epoch(date_trunc('second', ts)) range between 3599 preceding and current row) as last_3600s,
                    count(*) over (partition by event_type order by epoch(date_trunc('second', ts)) range between 86399 preceding and current row) as last_86400s
             from events) x""",
)
_BY_CHANNEL = {"click": routing.RateLimits(per_hour=2), "view": routing.RateLimits(per_minute=2, per_day=60), "error": routing.RateLimits()}
ORACLE["W7_limits_by_channel"] = ORACLE["W7_rate_limited"].replace(
    "last_60s <= 1 and last_3600s <= 4 and last_86400s <= 70 as allowed",
    """case channel when 'click' then last_3600s <= 2 when 'view' then last_60s <= 2 and last_86400s <= 60 when 'error' then true
            else last_60s <= 1 and last_3600s <= 4 and last_86400s <= 70 end as allowed""")
QUERIES["W7_limits_by_channel"] = lambda spark, sf: _limited(spark, sf, _BY_CHANNEL)
add(
    "W9_retain_days",
    lambda spark, sf: metrics.retain_days(t.runs(spark, sf), 30, utc("2001-07-01")).select("run_id", ts("start_time").alias("start_time")),
    f"select run_id, {sql_ts('start_time')} as start_time from runs where start_time >= timestamp '2001-07-01' - interval 30 day", ("runs",),
)


def _bounds(spark, sf):
    rows = t.load(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("as_of"))
    columns = []
    for period in ("hourly", "daily", "weekly", "monthly"):
        start, end = period_bounds(period, F.col("as_of") + F.expr("interval 1 hour 5 minutes"))
        columns += [ts(start).alias(f"{period}_start"), ts(end).alias(f"{period}_end")]
    approx, _ = period_bounds("monthly", F.col("as_of"), approx_month=True)
    return rows.select("o_orderkey", *columns, ts(approx).alias("approx_start"))


_TRUNC = "date_trunc('{unit}', o_orderdate + interval 65 minute)"
_BOUNDS = []
for _period, _unit in (("hourly", "hour"), ("daily", "day"), ("weekly", "week"), ("monthly", "month")):
    _end = _TRUNC.format(unit=_unit)
    _BOUNDS += [f"{sql_ts(f'{_end} - interval 1 {_unit}')} as {_period}_start", f"{sql_ts(_end)} as {_period}_end"]
_approx = "date_trunc('month', o_orderdate) - interval 30 day"
add(
    "F24_period_bounds", _bounds,
    f"select o_orderkey, {', '.join(_BOUNDS)}, {sql_ts(_approx)} as approx_start from orders",
)
