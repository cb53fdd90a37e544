"""The derived tables once more, as SQL views for the cross-check, and the query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_ATTEMPT = """
  select l_orderkey as run_id, concat('task_', cast(l_linenumber as varchar)) as task_id, {type}
         l_linenumber as ordinal,
         case when l_returnflag = 'N' then 'success'
              when l_returnflag = 'A' and l_linestatus = 'F' then 'success'
              when l_returnflag = 'A' then 'skipped'
              when l_linestatus = 'F' then 'failed'
              when l_suppkey % 2 = 0 then 'timeout'
              else 'cancelled' end as status,
         l_shipdate + to_minutes(cast(l_partkey % 1440 as int)) as start_time,
         case when l_tax <> 0 then l_shipdate + to_minutes(cast(l_partkey % 1440 as int))
              + to_milliseconds(cast(round(l_quantity * 1000) as bigint)) end as end_time,
         case when l_tax = 0 then null else cast(round(l_quantity * 1000) as bigint) end as duration_ms,
         cast(round(l_tax * 100) as int) as retry_count,
         case when l_returnflag = 'R' then concat('E', cast(l_suppkey % 5 as varchar), ': part ', cast(l_partkey as varchar)) end as error,
         l_partkey, l_suppkey, l_discount
  from lineitem {join}"""

_LATEST = """
  select * exclude (rn) from (
    select *, row_number() over (partition by run_id, task_id
                                 order by start_time desc, l_partkey desc, l_suppkey desc) as rn
    from {source}) x
  where rn = 1"""

# name -> (views it needs, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "attempts": ((), _ATTEMPT.format(type="p_type as task_type,", join="join part on l_partkey = p_partkey")),
    "attempts_core": ((), _ATTEMPT.format(type="", join="")),
    "typed_tasks": (("attempts",), _LATEST.format(source="attempts")),
    "tasks": (("attempts_core",), _LATEST.format(source="attempts_core")),
    "runs": ((), """
  select o_orderkey as run_id, concat('wf_', cast(o_custkey % 50 as varchar)) as workflow_name,
         o_orderdate + to_minutes(cast(o_orderkey % 1440 as int)) as start_time,
         case when o_orderstatus = 'P' then null
              else o_orderdate + to_minutes(cast(o_orderkey % 1440 + o_custkey % 90 as int)) end as end_time,
         case when o_orderstatus = 'P' then null else cast(o_custkey % 90 as bigint) * 60000 end as duration_ms,
         o_orderpriority as priority
  from orders"""),
    "facts": (("runs", "tasks"), """
  select r.run_id, any_value(workflow_name) as workflow_name, any_value(r.start_time) as start_time,
         any_value(r.end_time) as end_time, any_value(r.duration_ms) as duration_ms,
         case when coalesce(bool_or(t.status = 'running'), false) then 'running'
              when coalesce(bool_or(t.status in ('failed','timeout','cancelled')), false)
                   and coalesce(bool_or(t.status = 'success'), false) then 'partial_success'
              when coalesce(bool_or(t.status in ('failed','timeout','cancelled')), false) then 'failed'
              else 'success' end as status,
         count(t.task_id) as total_tasks,
         count(*) filter (t.status = 'success') as successful_tasks,
         count(*) filter (t.status in ('failed','timeout')) as failed_tasks,
         count(*) filter (t.status = 'skipped') as skipped_tasks,
         count(*) filter (t.status = 'cancelled') as cancelled_tasks,
         case when count(t.task_id) > 0
              then cast(count(*) filter (t.status = 'success') as double) / count(t.task_id) * 100 else 0.0 end as success_rate
  from runs r left join tasks t on r.run_id = t.run_id
  group by r.run_id"""),
    "named_tasks": (("runs", "tasks"), "select t.*, r.workflow_name from tasks t join runs r on t.run_id = r.run_id"),
    "named_typed": (("runs", "typed_tasks"), "select t.*, r.workflow_name from typed_tasks t join runs r on t.run_id = r.run_id"),
    "nodes": ((), "select distinct l_orderkey as run_id, l_linenumber as task from lineitem"),
    "edges": (("nodes",), """
  select run_id, src, dst from (
    select run_id, lag(task) over (partition by run_id order by task) as src, task as dst from nodes) c
  where src is not null
  union
  select b.run_id, a.task, b.task from nodes a join nodes b
    on a.run_id = b.run_id and a.task = b.task // 2 and b.task > 1"""),
    "paths": (("nodes", "edges"), """
  select run_id, task, 0 as lvl from nodes
  union
  select p.run_id, e.dst, p.lvl + 1 from paths p join edges e on e.run_id = p.run_id and e.src = p.task"""),
    "levels": (("paths",), "select run_id, task, cast(max(lvl) as int) as lvl from paths group by run_id, task"),
    "definitions": (("runs",), """
  select workflow_name, n as ordinal, concat('task_', cast(n as varchar)) as task_id,
         (['command','compress','checksum','email','slack','template','file'])[n] as task_type,
         n % 3 <> 0 as required,
         case when n % 4 <> 0 then n % 5 end as max_attempts,
         case when n % 4 <> 0 then cast(n * 250 as bigint) end as initial_delay_ms,
         case when n % 4 <> 0 then 1.0::double + n / 2.0::double end as backoff_multiplier
  from (select distinct workflow_name from runs) w, (select cast(unnest(range(1, 8)) as int) as n) s"""),
    "nested": ((), """
  select concat('wf_', cast(o_custkey % 50 as varchar)) as workflow_name, o_orderkey as run_id, o_custkey, o_orderpriority,
         (['success','failed','partial_success'])[o_custkey % 3 + 1] as status,
         o_orderdate + to_minutes(cast(o_orderkey % 1440 as int)) as start_time,
         cast(o_custkey % 90 * 60000 as bigint) as duration_ms
  from orders"""),
    "nested_tasks": (("nested",), """
  select workflow_name, run_id, cast(i - 1 as int) as ordinal, concat('task_', cast(i as varchar)) as task_id,
         o_orderpriority as task_type,
         (['success','failed','skipped','timeout','cancelled','running'])[(o_custkey + i) % 6 + 1] as status,
         start_time, cast((o_custkey + i) % 60 * 1000 as bigint) as duration_ms,
         concat('output of task ', cast(i as varchar)) as output,
         case when (o_custkey + i) % 6 = 1 then 'E1: failed' end as error,
         cast(i % 3 as int) as retry_count, cast((o_custkey + i) % 4 as varchar) as exit_code
  from (select *, unnest(range(1, o_custkey % 5 + 1)) as i from nested) x"""),
    "declared": (("typed_tasks",), """
  select run_id as workflow, task_id as task, ordinal, o_orderstatus,
         case when l_suppkey % 4 <> 0 then concat('job ', cast(l_partkey % 9 as varchar)) end as name,
         case when status = 'timeout' then 'decompress' else 'command' end as task_type,
         list_distinct(list_filter([
           case when ordinal > 1 then ordinal - 1 end,
           case when ordinal > 1 then ordinal // 2 end,
           case when ordinal = 1 and o_orderstatus = 'P' then 2 end,
           case when l_discount = 0 and error is not null then ordinal end], lambda x: x is not null)) as deps,
         case when retry_count < 8 then retry_count end as max_attempts,
         round(l_discount * 100) as backoff_multiplier,
         case ordinal when 3 then '{{ env }}' when 5 then '{{ a {{ b }} }}' when 6 then '{ open' when 7 then 'closed }' end as "when",
         case when status <> 'skipped' then status end as config
  from typed_tasks join orders on run_id = o_orderkey"""),
    "declared_edges": (("declared",), """
  select distinct workflow, concat('task_', cast(d as varchar)) as src, task as dst
  from (select workflow, task, unnest(deps) as d from declared) x"""),
    "declared_known": (("declared", "declared_edges"), """
  select e.* from declared_edges e
  where exists (select 1 from declared d where d.workflow = e.workflow and d.task = e.src)"""),
    "declared_reach": (("declared_known",), """
  select workflow, src, dst from declared_known
  union
  select r.workflow, r.src, k.dst from declared_reach r join declared_known k on k.workflow = r.workflow and k.src = r.dst"""),
    "declared_cyclic": (("declared", "declared_reach"), """
  select distinct workflow, src as task from declared_reach where src = dst"""),
    "declared_lost": (("declared", "declared_edges", "declared_reach"), """
  with roots as (select workflow, task from declared d where len(deps) = 0)
  select d.workflow, d.task from declared d
  where d.workflow in (select workflow from roots)
    and not exists (select 1 from roots r where r.workflow = d.workflow and r.task = d.task)
    and not exists (select 1 from roots r join declared_reach x on x.workflow = r.workflow and x.src = r.task
                    where r.workflow = d.workflow and x.dst = d.task)"""),
    "braces": (("declared",), """
  select workflow, task, ordinal,
         case when "when" is null then null
              when regexp_full_match(b, '(\\{(\\{\\})*\\})*') then null
              when regexp_matches(b, '^(\\{(\\{\\})*\\})*\\}') then 'unmatched closing brace'
              when regexp_matches(b, '^(\\{(\\{\\})*\\})*\\{(\\{\\})*\\{\\{') then 'nested template expressions not allowed'
              else 'unmatched template braces' end as problem
  from (select *, regexp_replace("when", '[^{}]', '', 'g') as b from declared) x"""),
    "workflows": ((), """
  select o_orderkey as workflow,
         case when o_custkey % 50 <> 0 then concat('wf_', cast(o_custkey % 50 as varchar)) else ' ' end as workflow_name,
         case o_orderpriority when '1-URGENT' then 's3://bucket/x' when '2-HIGH' then 'file:///out/x' when '3-MEDIUM' then 's3:///x'
              when '4-NOT SPECIFIED' then 'ftp://host/x'
              else case when o_orderstatus = 'F' then ' ' else 'no url' end end as url
  from orders"""),
    "config_issues": (("declared",), """
  select workflow, task, ordinal, 'error' as severity,
         case when config is not null and task_type = 'decompress' then 'task_type' else 'config' end as kind,
         case when config is not null and task_type = 'decompress'
              then concat('Unsupported task type ''', task_type, ''' in task ''', task, '''. Supported types: ["command", "compress", "checksum", "archive", "file", "s3", "email", "slack", "template"]')
              else concat('Invalid task configuration for ''', task, ''': ',
                case when config is null then 'task config cannot be null'
                     when max_attempts = 0 then 'max_attempts must be greater than 0'
                     else 'backoff_multiplier must be greater than 0' end) end as message
  from declared
  where config is null or task_type = 'decompress' or max_attempts = 0 or backoff_multiplier <= 0"""),
    "issues": (("declared", "declared_edges", "declared_cyclic", "declared_lost", "braces", "workflows", "config_issues"), """
  select * from config_issues
  union all select workflow, task, ordinal, 'error', 'template',
         concat('Invalid template syntax in ''tasks.', task, '.when'': ', problem) from braces where problem is not null
  union all select d.workflow, e.dst, d.ordinal, 'error', 'unknown_dependency',
         concat('Task ''', e.dst, ''' depends on unknown task ''', e.src, '''')
    from declared_edges e join declared d on d.workflow = e.workflow and d.task = e.dst
    where not exists (select 1 from declared s where s.workflow = e.workflow and s.task = e.src)
  union all select c.workflow, c.task, d.ordinal, 'error', 'cycle',
         concat('Circular dependency detected in tasks: ["', c.task, '"]')
    from declared_cyclic c join declared d on d.workflow = c.workflow and d.task = c.task
  union all select d.workflow, d.task, d.ordinal, 'error', 'self_dependency', concat('Task ''', d.task, ''' depends on itself')
    from declared_edges e join declared d on d.workflow = e.workflow and d.task = e.dst where e.src = e.dst
  union all select l.workflow, l.task, d.ordinal, 'warning', 'unreachable', concat('Task ''', l.task, ''' is unreachable')
    from declared_lost l join declared d on d.workflow = l.workflow and d.task = l.task
  union all select workflow, null, min(ordinal), 'error', 'duplicate', concat('Duplicate task name: ', coalesce(name, task))
    from declared group by workflow, coalesce(name, task) having count(*) > 1
  union all select workflow, null, -1, 'warning', 'no_root', 'No root tasks found - all tasks have dependencies'
    from declared group by workflow having min(len(deps)) > 0
  union all select workflow, null, -1, 'error', 'name', 'Missing required field: name' from workflows where trim(workflow_name) = ''
  union all select workflow, null, -1, 'error', 'output', concat('Invalid output configuration: ',
         case url when ' ' then 'destination cannot be empty' when 'no url' then 'Invalid output destination URL'
                  when 's3:///x' then 'S3 URL must include bucket name as host' else 'Unsupported output scheme: ftp' end)
    from workflows where url in (' ', 'no url', 's3:///x', 'ftp://host/x')
  union all select workflow, null, -1, 'error', 'empty', 'Empty workflow: no tasks defined'
    from workflows w where not exists (select 1 from declared d where d.workflow = w.workflow)"""),
    "stream_events": ((), """
  select event_id, cast(user_id as varchar) as run_id, event_type as task_type, ts as start_time,
         case when event_type = 'error' then 'failed' else 'success' end as status,
         cast(round(value * 1000) as bigint) as duration_ms
  from events"""),
}

_RECURSIVE = {"paths", "declared_reach"}


def with_views(body: str, *names: str) -> str:
    """``body`` behind the WITH list of the views it names, their own needs first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for needed in VIEWS[name][0]:
                visit(needed)
            order.append(name)

    for name in names:
        visit(name)
    if not order:
        return body
    recursive = "recursive " if _RECURSIVE & set(order) else ""
    heads = [f"{name} as ({VIEWS[name][1]})" for name in order]
    return f"with {recursive}" + ",\n".join(heads) + "\n" + body


def add(name: str, query: Query, sql: str | None = None, views: tuple[str, ...] = ()) -> None:
    """Register a query and, where SQL can express it, its cross-check."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = with_views(sql, *views)


def ts(c: Column | str) -> Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss")


def rounded(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def sql_ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
