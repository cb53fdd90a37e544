"""Catalog: report tables, routing and delivery rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import utc
from ..operators import metrics, reports, route_reports, routing
from ..sources import writers
from . import tables as t
from .oracle import add, sql_ts

AT = "2024-05-06 07:08:09"
UTC_TEXT = "'%Y-%m-%d %H:%M:%S UTC'"


def _at():
    return utc(AT)


def _named(spark, sf):
    return t.named_tasks(spark, sf)


def _pick(df, *keys):
    """Report columns as plain text; the metadata map as sorted pairs."""
    pairs = F.array_join(
        F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
    )
    return df.select(*keys, "report_type", "title", "content", pairs.alias("metadata"))


def _took(ms: str) -> str:
    return f"case when {ms} is not null then concat(' (took ', printf('%.1f', {ms} / 1000.0::double), 's)') else '' end"


def _done(label: str) -> str:
    return f"case when end_time is not null then concat('{label}', strftime(end_time, {UTC_TEXT}), chr(10)) else '' end"


_NL = "chr(10)"
_DIGEST = """(select run_id, concat(chr(10), '**Failed Tasks:**', chr(10),
         string_agg(case when rn <= 5 then concat('- ', task_id, ' (', task_type, '): ', coalesce(error, 'Unknown error'), chr(10)) else '' end, '' order by rn),
         case when count(*) > 5 then concat('- ... and ', cast(count(*) - 5 as varchar), ' more', chr(10)) else '' end) as digest, count(*) as failures
       from (select *, row_number() over (partition by run_id order by ordinal) as rn from typed_tasks
             where status in ('failed','timeout','cancelled')) x group by run_id)"""

add(
    "W2_failed_task_digest",
    lambda spark, sf: reports.failed_task_digest(t.task_runs(spark, sf)),
    f"select run_id, failures, digest from {_DIGEST} d", ("typed_tasks",),
)
_RUN_ICON = "case status when 'success' then '✅' when 'failed' then '❌' when 'cancelled' then '⚠️' else 'ℹ️' end"
add(
    "R5_run_summary",
    lambda spark, sf: _pick(reports.report_run_summary(*t.facts_and_tasks(spark, sf), at=_at()), "run_id"),
    f"""select f.run_id, 'summary' as report_type, concat('Workflow Summary: ', workflow_name, ' - ', status) as title,
              concat({_RUN_ICON}, ' **Workflow Summary**', {_NL}, {_NL}, '**Workflow:** ', workflow_name, {_NL}, '**Run ID:** ',
                cast(f.run_id as varchar), {_NL}, '**Status:** ', status, {_took('duration_ms')}, {_NL}, '**Started:** ',
                strftime(start_time, {UTC_TEXT}), {_NL}, {_done('**Completed:** ')}, {_NL}, '**Task Summary:**', {_NL}, '- Total: ',
                cast(total_tasks as varchar), {_NL}, '- Successful: ', cast(successful_tasks as varchar), ' (', printf('%.1f', success_rate::double),
                '%)', {_NL}, '- Failed: ', cast(failed_tasks as varchar), {_NL}, '- Skipped: ', cast(skipped_tasks as varchar), {_NL},
                coalesce(digest, '')) as content,
              concat('generator=summary,run_id=', cast(f.run_id as varchar), ',status=', status, ',template=default,workflow_name=', workflow_name) as metadata
       from facts f left join {_DIGEST} d on d.run_id = f.run_id""",
    ("facts", "typed_tasks"),
)
_TASK_ICON = "case when status = 'success' then '✅' when status in ('failed','timeout','cancelled') then '❌' when status = 'skipped' then '⚠️' else 'ℹ️' end"
add(
    "R6_task_summary",
    lambda spark, sf: _pick(reports.report_task_summary(_named(spark, sf), at=_at()), "run_id", "task_id"),
    f"""select run_id, task_id, 'summary' as report_type, concat('Task Summary: ', task_id, ' in ', workflow_name, ' - ', status) as title,
              concat({_TASK_ICON}, ' **Task Summary**', {_NL}, {_NL}, '**Task:** ', task_id, {_NL}, '**Type:** ', task_type, {_NL}, '**Workflow:** ',
                workflow_name, ' (', cast(run_id as varchar), ')', {_NL}, '**Status:** ', status, {_took('duration_ms')}, {_NL}, '**Started:** ',
                strftime(start_time, {UTC_TEXT}), {_NL}, {_done('**Completed:** ')},
                case when retry_count > 0 then concat('**Retries:** ', cast(retry_count as varchar), {_NL}) else '' end,
                case when error is not null then concat({_NL}, '**Error:**', {_NL}, '```', {_NL}, error, {_NL}, '```', {_NL}) else '' end) as content,
              concat('generator=summary,status=', status, ',task_id=', task_id, ',task_type=', task_type, ',template=default,workflow_name=', workflow_name) as metadata
       from named_typed""",
    ("named_typed",),
)


def _monthly(spark, sf):
    series = metrics.period_series(*t.facts_and_tasks(spark, sf, False), "monthly")
    return series.withColumn("period_end", F.add_months("period_start", 1).cast("timestamp"))


_SERIES = """(select coalesce(r.p, t.p) as p, coalesce(total_workflows, 0) as total_workflows, coalesce(ok, 0) as ok, coalesce(bad, 0) as bad,
         wd, coalesce(total_tasks, 0) as total_tasks, coalesce(tok, 0) as tok, coalesce(tbad, 0) as tbad, coalesce(tskip, 0) as tskip,
         coalesce(tcancel, 0) as tcancel, coalesce(tout, 0) as tout, td,
         case when coalesce(total_workflows, 0) > 0 then cast(ok as double) / total_workflows * 100 else 0.0 end as rate,
         case when coalesce(total_tasks, 0) > 0 then cast(tok as double) / total_tasks * 100 else 0.0 end as trate
       from (select date_trunc('month', start_time) as p, count(*) as total_workflows, count(*) filter (status = 'success') as ok,
                    count(*) filter (status = 'failed') as bad, avg(duration_ms) as wd from facts group by 1) r
       full join (select date_trunc('month', start_time) as p, count(*) as total_tasks, count(*) filter (status = 'success') as tok,
                    count(*) filter (status = 'failed') as tbad, count(*) filter (status = 'skipped') as tskip,
                    count(*) filter (status = 'cancelled') as tcancel, count(*) filter (status = 'timeout') as tout, avg(duration_ms) as td
                  from tasks group by 1) t on r.p = t.p)"""


def _average(c: str) -> str:
    return f"case when {c} is not null then concat('- Average duration: ', printf('%.1f', {c} / 1000.0::double), 's', {_NL}) else '' end"


_MONTH_TEXT = f"""concat('📊 **Monthly Metrics Summary**', {_NL}, {_NL}, '**Period:** ', strftime(p, {UTC_TEXT}), ' to ',
                strftime(p + interval 1 month, {UTC_TEXT}), {_NL}, '**Generated:** {AT} UTC', {_NL}, {_NL}, '**Workflow Statistics:**', {_NL},
                '- Total workflows: ', cast(total_workflows as varchar), {_NL}, '- Successful: ', cast(ok as varchar), ' (', printf('%.1f', rate), '%)', {_NL},
                '- Failed: ', cast(bad as varchar), {_NL}, {_average('wd')}, {_NL}, '**Task Statistics:**', {_NL}, '- Total tasks: ',
                cast(total_tasks as varchar), {_NL}, '- Successful: ', cast(tok as varchar), ' (', printf('%.1f', trate), '%)', {_NL}, '- Failed: ',
                cast(tbad as varchar), {_NL}, '- Skipped: ', cast(tskip as varchar), {_NL}, '- Cancelled: ', cast(tcancel as varchar), {_NL}, {_average('td')})"""

add(
    "R7_period_summary",
    lambda spark, sf: _pick(
        reports.report_period(_monthly(spark, sf), "monthly", "nightly", at=_at()).withColumn(
            "period", F.date_format("period_start", "yyyy-MM")), "period"),
    f"""select strftime(p, '%Y-%m') as period, 'summary' as report_type, 'Monthly nightly Report' as title,
              {_MONTH_TEXT} as content,
              'generator=summary,period=Monthly,template=nightly' as metadata
       from {_SERIES} s""",
    ("facts", "tasks"),
)

_ENTRY_ICON = "case when status = 'success' then '✅' when status = 'skipped' then '⚠️' else '❌' end"
_SECONDS = "case when duration_ms is not null then concat('- **Duration:** ', printf('%.2f', duration_ms / 1000.0::double), ' seconds', chr(10)) else '' end"


def _retries(label: str) -> str:
    return f"case when retry_count > 0 then concat('- **{label}:** ', cast(retry_count as varchar), {_NL}) else '' end"


def _error(label: str) -> str:
    return f"case when error is not null then concat({_NL}, '**{label}:**', {_NL}, '```', {_NL}, error, {_NL}, '```', {_NL}) else '' end"


_ENTRY = f"""concat('### ', {_ENTRY_ICON}, ' ', task_id, ' (', task_type, ')', {_NL}, '- **Status:** ', status, {_NL}, '- **Started:** ',
         strftime(start_time, {UTC_TEXT}), {_NL}, {_done('- **Completed:** ')}, {_SECONDS}, {_retries('Retries')}, {_error('Error')}, {_NL})"""

add(
    "R8_run_detailed",
    lambda spark, sf: _pick(
        reports.report_run_detailed(
            *t.facts_and_tasks(spark, sf),
            routing.Filters(task_status=["Success", "Failed", "Timeout"], max_duration_seconds=45), at=_at()),
        "run_id", "page"),
    f"""select f.run_id, cast(0 as bigint) as page, 'detailed' as report_type, concat('Detailed Workflow Report: ', workflow_name, ' - ', status) as title,
              concat('# Workflow Execution Report', {_NL}, {_NL}, '## Overview', {_NL}, '- **Workflow Name:** ', workflow_name, {_NL}, '- **Run ID:** ',
                cast(f.run_id as varchar), {_NL}, '- **Status:** ', status, {_NL}, '- **Started:** ', strftime(start_time, {UTC_TEXT}), {_NL},
                {_done('- **Completed:** ')}, {_SECONDS}, {_NL}, '## Task Statistics', {_NL}, '- **Total Tasks:** ', cast(total_tasks as varchar), {_NL},
                '- **Successful:** ', cast(successful_tasks as varchar), ' (', printf('%.1f', success_rate::double), '%)', {_NL}, '- **Failed:** ',
                cast(failed_tasks as varchar), {_NL}, '- **Skipped:** ', cast(skipped_tasks as varchar), {_NL}, '- **Success Rate:** ',
                printf('%.1f', success_rate::double), '%', {_NL},
                case when total_tasks > 0 then concat({_NL}, '## Task Details', {_NL}, {_NL}) else '' end, coalesce(entries, '')) as content,
              concat('generator=detailed,run_id=', cast(f.run_id as varchar), ',task_count=', cast(total_tasks as varchar),
                ',template=default,workflow_name=', workflow_name) as metadata
       from facts f left join (select run_id, string_agg(entry, '' order by ordinal) as entries
         from (select run_id, ordinal, {_ENTRY} as entry from typed_tasks
               where status in ('success','failed','timeout') and (duration_ms is null or duration_ms // 1000 <= 45)) e group by run_id) x
       on x.run_id = f.run_id""",
    ("facts", "typed_tasks"),
)
add(
    "R9_task_detailed",
    lambda spark, sf: _pick(reports.report_task_detailed(_named(spark, sf), at=_at()), "run_id", "task_id"),
    f"""select run_id, task_id, 'detailed' as report_type, concat('Detailed Task Report: ', task_id, ' in ', workflow_name, ' - ', status) as title,
              concat('# Task Execution Report', {_NL}, {_NL}, '## ', {_ENTRY_ICON}, ' Task: ', task_id, {_NL}, {_NL}, '### Overview', {_NL}, '- **Task ID:** ',
                task_id, {_NL}, '- **Task Type:** ', task_type, {_NL}, '- **Status:** ', status, {_NL}, '- **Workflow:** ', workflow_name, ' (Run: ',
                cast(run_id as varchar), ')', {_NL}, '- **Started:** ', strftime(start_time, {UTC_TEXT}), {_NL}, {_done('- **Completed:** ')}, {_SECONDS},
                {_retries('Retry Count')}, {_NL}, '### Execution Details', {_NL}, {_error('Error Details')}) as content,
              concat('generator=detailed,task_id=', task_id, ',task_type=', task_type, ',template=default,workflow_name=', workflow_name) as metadata
       from named_typed""",
    ("named_typed",),
)


def _json(spark, sf):
    rows = _monthly(spark, sf).select(
        "period_start", "total_workflows", "successful_workflows", "failed_workflows", "total_tasks", "timeout_tasks"
    )
    out = reports.report_metrics_json(rows, "monthly", at=_at())
    return out.select(F.date_format("period_start", "yyyy-MM").alias("period"), "title", F.json_object_keys("content").cast("string").alias("fields"),
                      F.get_json_object("content", "$.total_workflows").cast("long").alias("total_workflows"),
                      F.get_json_object("content", "$.total_tasks").cast("long").alias("total_tasks"))


add(
    "R10_metrics_json", _json,
    f"""select strftime(p, '%Y-%m') as period, 'Metrics Report - Monthly' as title,
              '[period_start, total_workflows, successful_workflows, failed_workflows, total_tasks, timeout_tasks]' as fields,
              total_workflows, total_tasks from {_SERIES} s""",
    ("facts", "tasks"),
)
_LIST_ICON = "case when status = 'success' then '✓' when status = 'skipped' then '⊘' else '✗' end"
add(
    "R11_format_text",
    lambda spark, sf: reports.format_text(*t.facts_and_tasks(spark, sf), successful=True, failed=True),
    f"""select f.run_id, cast(0 as bigint) as page,
              concat('Workflow: ', workflow_name, ' (', cast(f.run_id as varchar), ')', {_NL}, 'Status: ', status, {_NL}, 'Started: ',
                strftime(start_time, {UTC_TEXT}), {_NL}, {_done('Completed: ')},
                case when duration_ms is not null then concat('Duration: ', printf('%.2f', duration_ms / 1000.0::double), 's', {_NL}) else '' end, {_NL},
                'Summary:', {_NL}, '  Total tasks: ', cast(total_tasks as varchar), {_NL}, '  Successful: ', cast(successful_tasks as varchar), {_NL},
                '  Failed: ', cast(failed_tasks as varchar), {_NL}, '  Skipped: ', cast(skipped_tasks as varchar), {_NL}, '  Success rate: ',
                printf('%.1f', success_rate::double), '%', {_NL}, case when total_tasks > 0 then concat({_NL}, 'Tasks:', {_NL}) else '' end,
                coalesce(entries, '')) as content
       from facts f left join (select run_id, string_agg(concat('  ', {_LIST_ICON}, ' ', task_id, ' (', task_type, ')',
             case when duration_ms is not null then concat(' [', printf('%.2f', duration_ms / 1000.0::double), 's]') else '' end,
             case when retry_count > 0 then concat(' (retried ', cast(retry_count as varchar), ' times)') else '' end,
             case when error is not null then concat({_NL}, '      Error: ', error) else '' end, {_NL}, {_NL}), '' order by ordinal) as entries
         from typed_tasks where status <> 'skipped' group by run_id) x on x.run_id = f.run_id""",
    ("facts", "typed_tasks"),
)
add(
    "R12_titles",
    lambda spark, sf: t.facts(spark, sf).select(
        "run_id", reports.template_title("run").alias("plain"), reports.template_title("run", template="nightly").alias("prefixed"),
        reports.template_title("run", custom="My title").alias("custom"), reports.template_title("task").alias("task"),
        reports.template_title("period", period="weekly").alias("period"),
    ),
    """select run_id, concat(workflow_name, ' - Workflow ', status, ' Report') as plain,
              concat('nightly - ', workflow_name, ' - Workflow ', status, ' Report') as prefixed, 'My title' as custom,
              concat(workflow_name, ' - Task ', status, ' Report') as task, 'Weekly Metrics Report' as period
       from facts""",
    ("facts",),
)
add(
    "R13_metadata",
    lambda spark, sf: t.facts(spark, sf).select(
        "run_id", F.explode(reports.template_metadata("run", "nightly", "summary", _at(), {"team": "data"})).alias("key", "value")
    ),
    f"""select run_id, unnest(['template_name','generator_type','generated_at','data_type','workflow_name','run_id','template_var_team']) as key,
              unnest(['nightly','summary','{AT.replace(' ', 'T')}.000Z','workflow_completion', workflow_name, cast(run_id as varchar), 'data']) as value
       from facts""",
    ("facts",),
)


def _payloads(spark, sf):
    made = reports.report_run_summary(*t.facts_and_tasks(spark, sf), at=_at())
    body = reports.report_payload(made)
    return body.select(
        "run_id", F.get_json_object("message", "$.text").alias("text"),
        *[F.get_json_object("request", f"$.report.{n}").alias(n) for n in ("title", "type", "generated_at")],
        F.get_json_object("request", "$.report.metadata.status").alias("status"),
    )


add(
    "R14_payload", _payloads,
    f"""select run_id, concat('📋 *Workflow Summary: ', workflow_name, ' - ', status, '*', {_NL}, {_NL}, content) as text,
              concat('Workflow Summary: ', workflow_name, ' - ', status) as title, 'summary' as type,
              '{AT.replace(' ', 'T')}.000Z' as generated_at, status
       from (select f.run_id, workflow_name, status,
              concat({_RUN_ICON}, ' **Workflow Summary**', {_NL}, {_NL}, '**Workflow:** ', workflow_name, {_NL}, '**Run ID:** ',
                cast(f.run_id as varchar), {_NL}, '**Status:** ', status, {_took('duration_ms')}, {_NL}, '**Started:** ',
                strftime(start_time, {UTC_TEXT}), {_NL}, {_done('**Completed:** ')}, {_NL}, '**Task Summary:**', {_NL}, '- Total: ',
                cast(total_tasks as varchar), {_NL}, '- Successful: ', cast(successful_tasks as varchar), ' (', printf('%.1f', success_rate::double),
                '%)', {_NL}, '- Failed: ', cast(failed_tasks as varchar), {_NL}, '- Skipped: ', cast(skipped_tasks as varchar), {_NL},
                coalesce(digest, '')) as content
             from facts f left join {_DIGEST} d on d.run_id = f.run_id) x""",
    ("facts", "typed_tasks"),
)


def _resolved(spark, sf):
    c = F.col
    routes = t.load(spark, sf, "customer").select(
        c("c_name").alias("name"), F.when(c("c_custkey") % 3 == 0, F.concat(F.lit("own "), "c_name")).alias("template_content"),
        F.concat(F.lit("file_"), c("c_nationkey").cast("string")).alias("template_file"),
    )
    by_name = t.load(spark, sf, "customer").filter(c("c_mktsegment") == "BUILDING").select(c("c_name").alias("name"), c("c_mktsegment").alias("content"))
    by_file = t.load(spark, sf, "nation").filter("n_regionkey < 3").select(
        F.concat(F.lit("file_"), c("n_nationkey").cast("string")).alias("path"), c("n_name").alias("content"))
    return routing.resolve_templates(routes, by_name, by_file)


add(
    "R15_resolve_templates", _resolved,
    """select c_name as name, case when c_custkey % 3 = 0 then concat('own ', c_name) when c_mktsegment = 'BUILDING' then c_mktsegment
              when n_regionkey < 3 then n_name end as content,
              c_custkey % 3 = 0 or c_mktsegment = 'BUILDING' or n_regionkey < 3 as resolved
       from customer join nation on c_nationkey = n_nationkey""",
)


def _generated(spark, sf):
    run, tasks = t.facts_and_tasks(spark, sf)
    made = [
        reports.generate_reports("summary", "run", runs=run, tasks=tasks, at=_at()),
        reports.generate_reports("detailed", "run", runs=run, tasks=tasks, at=_at()),
        reports.generate_reports("summary", "task", tasks=_named(spark, sf), at=_at()),
        reports.generate_reports("detailed", "task", tasks=_named(spark, sf), at=_at()),
        reports.generate_reports("metrics", "period", metrics=_monthly(spark, sf), period="monthly", at=_at()),
    ]
    columns = ["report_type", "title", "content", "metadata", "generated_at"]
    everything = made[0].select(*columns)
    for more in made[1:]:
        everything = everything.unionByName(more.select(*columns))
    return everything.groupBy("report_type").agg(F.count("*").alias("reports"), F.count_distinct("title").alias("titles"))


add(
    "R16_generate_reports", _generated,
    """select report_type, count(*) as reports, count(distinct title) as titles from (
         select 'summary' as report_type, concat('r', workflow_name, status) as title from facts
         union all select 'detailed', concat('r', workflow_name, status) from facts
         union all select 'summary', concat('t', task_id, workflow_name, status) from named_tasks
         union all select 'detailed', concat('t', task_id, workflow_name, status) from named_tasks
         union all select 'metrics', 'm' from (select distinct date_trunc('month', start_time) from (
             select start_time from facts union all select start_time from tasks) u) m) x
       group by report_type""",
    ("facts", "tasks", "named_tasks"),
)


DIGEST = routing.Route(
    "digest", "template", trigger_on_workflow_completion=True, variables={"team": "data", "title": "Nightly", "status": "hidden"},
    template_content="{{team}} {{env}} {{date}}\n{{workflow_name}} {{status}} {{workflow.summary.successful_tasks}}/{{total_tasks}}{{workflow.nothing}} {{template_name}}")
RUN_ROUTES = (
    DIGEST,
    routing.Route("broken runs", "template", trigger_on_workflow_completion=True, filters=routing.Filters(workflow_status=["Failed"])),
    routing.Route("failed tasks", "detailed", trigger_on_workflow_completion=True,
                  filters=routing.Filters(workflow_status=["Failed"], task_status=["Failed"])),
    routing.Route("few", "summary", trigger_on_workflow_completion=True, filters=routing.Filters(workflow_names=["wf_1", "wf_2"])),
)
NAMED = {"broken runs": "{{env}} {{run_id}} {{metrics.failed_tasks}}"}


def _routed(spark, sf):
    run, tasks = t.facts_and_tasks(spark, sf)
    made = route_reports.report_routes("run", run, RUN_ROUTES, tasks, NAMED, {"env": "prod", "team": "nobody"}, _at())
    entries = F.size(F.split("content", "\n### ")) - 1
    return made.select(
        "run_id", "route", "page", "title", F.when(F.col("report_type") == "detailed", entries.cast("string"))
        .when(F.col("report_type") == "summary", F.col("metadata")["template"]).otherwise(F.col("content")).alias("content"))


add(
    "R16_route_reports", _routed,
    f"""select *, cast(0 as bigint) as page from (
         select run_id, 'digest' as route, 'Nightly' as title, concat('data prod {AT[:10]}', {_NL}, workflow_name, ' ', status, ' ',
                cast(successful_tasks as varchar), '/', cast(total_tasks as varchar), ' digest') as content from facts where status <> 'running'
         union all select run_id, 'broken runs', concat('broken runs - ', workflow_name, ' - Workflow ', status, ' Report'),
                concat('prod ', cast(run_id as varchar), ' ', cast(failed_tasks as varchar)) from facts where status = 'failed'
         union all select run_id, 'failed tasks', concat('Detailed Workflow Report: ', workflow_name, ' - ', status),
                cast((select count(*) from tasks t where t.run_id = f.run_id and t.status = 'failed') as varchar) from facts f where status = 'failed'
         union all select run_id, 'few', concat('Workflow Summary: ', workflow_name, ' - ', status), 'few' from facts
                where status <> 'running' and workflow_name in ('wf_1', 'wf_2')) x""",
    ("facts", "tasks"),
)


def _routed_tasks(spark, sf):
    routes = (
        routing.Route("alerts", "template", trigger_on_task_failure=True,
                      template_content="{{upper task_id}} {{task.duration_ms}} {{workflow_context.workflow_name}} {{error}}|{{output}}"),
        routing.Route("slow", "summary", trigger_on_task_failure=True, filters=routing.Filters(task_status=["Timeout"], min_duration_seconds=30)),
    )
    return route_reports.report_routes("task", _named(spark, sf), routes, at=_at()).select(
        "run_id", "task_id", "route", "title", F.when(F.col("route") == "alerts", F.col("content")).alias("content"))


add(
    "R16_task_route_reports", _routed_tasks,
    """select run_id, task_id, 'alerts' as route, concat('alerts - ', workflow_name, ' - Task ', status, ' Report') as title,
              concat(upper(task_id), ' ', coalesce(cast(duration_ms as varchar), ''), ' ', workflow_name, ' ', coalesce(error, ''), '|') as content
       from named_typed where status in ('failed','timeout','cancelled')
       union all
       select run_id, task_id, 'slow', concat('Task Summary: ', task_id, ' in ', workflow_name, ' - ', status), null
       from named_typed where status = 'timeout' and coalesce(duration_ms // 1000 >= 30, true)""",
    ("named_typed",),
)


def _period_template(spark, sf):
    route = routing.Route("trend", "template", period="monthly", template_content="{{period}} {{total_workflows}} {{metrics.failed_tasks}} {{generated_at}}")
    rows = _monthly(spark, sf).withColumn("route", F.lit("trend"))
    made = reports.generate_reports("template", "period", rows=rows, routes=[route], texts=route_reports.route_texts([route]), period="monthly", at=_at())
    return made.select(F.date_format("period_start", "yyyy-MM").alias("period"), "title", "content")


add(
    "R16_period_template", _period_template,
    f"""select strftime(p, '%Y-%m') as period, 'trend - Monthly Metrics Report' as title,
              concat('Monthly ', cast(total_workflows as varchar), ' ', cast(tbad as varchar), ' {AT.replace(' ', 'T')}.000Z') as content from {_SERIES} s""",
    ("facts", "tasks"),
)


PERIOD_ROUTES = (
    routing.Route("trend", "template", period="monthly", variables={"team": "data"},
                  template_content="{{team}} {{period}} {{total_workflows}} {{metrics.failed_tasks}} {{generated_at}}"),
    routing.Route("closing", "summary", period="monthly"),
    routing.Route("deep", "detailed", period="monthly"),
    routing.Route("numbers", "metrics", period="monthly"),
    routing.Route("weekly", "summary", period="weekly"),
    routing.Route("off", "summary", enabled=False, period="monthly"),
    routing.Route("runs only", "summary", trigger_on_workflow_completion=True),
)
_COUNTS = ("total_workflows", "successful_workflows", "failed_workflows", "total_tasks", "successful_tasks", "failed_tasks", "skipped_tasks", "cancelled_tasks")


def _period_routes(spark, sf):
    made = route_reports.report_routes("period", _monthly(spark, sf), PERIOD_ROUTES, variables={"team": "none"}, at=_at(), period="monthly")
    counts = F.concat_ws(" ", *[F.get_json_object("content", f"$.{c}") for c in _COUNTS])
    return made.select(F.date_format("period_start", "yyyy-MM").alias("period"), "route", "report_type", "title", "page",
                       F.when(F.col("route") == "numbers", counts).otherwise(F.col("content")).alias("content"))


add(
    "R16_period_route_reports", _period_routes,
    f"""select *, cast(0 as bigint) as page from (with s as (select strftime(p, '%Y-%m') as period, *, {_MONTH_TEXT} as summary from {_SERIES} x)
         select period, 'trend' as route, 'template' as report_type, 'trend - Monthly Metrics Report' as title,
                concat('data Monthly ', cast(total_workflows as varchar), ' ', cast(tbad as varchar), ' {AT.replace(' ', 'T')}.000Z') as content from s
         union all select period, 'closing', 'summary', 'Monthly closing Report', summary from s
         union all select period, 'deep', 'detailed', 'Detailed Monthly deep Report', summary from s
         union all select period, 'numbers', 'metrics', 'Metrics Report - Monthly',
                concat_ws(' ', total_workflows, ok, bad, total_tasks, tok, tbad, tskip, tcancel) from s) x""",
    ("facts", "tasks"),
)


def _owners(runs, **_):
    return runs.select("run_id", F.lit("owners").alias("report_type"), F.concat(F.lit("Owner of "), "workflow_name").alias("title"))


def _custom(spark, sf):
    reports.register_generator("owners", "run", _owners)
    return reports.generate_reports("owners", "run", runs=t.facts(spark, sf))


add(
    "X2_register_generator", _custom,
    "select run_id, 'owners' as report_type, concat('Owner of ', workflow_name) as title from runs", ("runs",),
)


def _layout(spark, sf):
    made = reports.report_run_summary(*t.facts_and_tasks(spark, sf), at=F.current_timestamp())
    made = made.join(t.runs(spark, sf).select("run_id", "start_time"), "run_id").withColumn("generated_at", F.col("start_time"))
    return writers.partition_layout(made, "{type} {title}_{timestamp}.txt").select(
        "run_id", "report_type", "date", "file_name", reports.report_subject("[{type}] {title} at {generated_at}").alias("subject")
    )


add(
    "S12_partition_layout", _layout,
    f"""select run_id, 'summary' as report_type, strftime(start_time, '%Y-%m-%d') as date,
              concat('summary_Workflow_Summary__', workflow_name, '_-_', status, '_', strftime(start_time, '%Y%m%d_%H%M%S'), '.txt') as file_name,
              concat('[summary] Workflow Summary: ', workflow_name, ' - ', status, ' at ', {sql_ts('start_time')}) as subject
       from facts""",
    ("facts",),
)
