"""Catalog: dependency graphs and definition checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import dag, validation
from ..session import stored
from . import tables as t
from .oracle import add, rounded

KEY = "run_id"


def _levels(spark, sf):
    return dag.dag_levels(t.nodes(spark, sf), t.edges(spark, sf), KEY)


def _declared(spark, sf):
    # Definitions are a stored table in use; here they are derived, so derive them once.
    definitions = stored(t.declared_tasks(spark, sf).select("workflow", "task", "depends_on"), "definitions")
    return definitions.select("workflow", "task"), dag.dag_edges(definitions)


add(
    "G1_edges",
    lambda spark, sf: dag.dag_edges(t.declared_tasks(spark, sf)),
    "select workflow, src, dst from declared_edges", ("declared_edges",),
)
add("G2_levels", lambda spark, sf: _levels(spark, sf), "select run_id, task, lvl from levels", ("levels",))
add(
    "G12_batch_index",
    lambda spark, sf: _levels(spark, sf).filter("lvl = 1"),
    "select run_id, task, lvl from levels where lvl = 1", ("levels",),
)
add(
    "G3_cycles",
    lambda spark, sf: dag.dag_cycles(*_declared(spark, sf)),
    """select c.workflow, c.task, least(c.task, coalesce(min(r.dst), c.task)) as component
       from declared_cyclic c left join declared_reach r on r.workflow = c.workflow and r.src = c.task
            and exists (select 1 from declared_reach b where b.workflow = r.workflow and b.src = r.dst and b.dst = c.task)
       group by c.workflow, c.task""", ("declared_cyclic", "declared_reach"),
)
add(
    "G2_levels_with_cycles",
    lambda spark, sf: dag.dag_levels(*_declared(spark, sf)).groupBy("lvl").agg(F.count("*").alias("tasks")),
    """select lvl, count(*) as tasks from (
         select d.workflow, d.task,
                case when exists (select 1 from declared_cyclic c where c.workflow = d.workflow and c.task = d.task)
                       or exists (select 1 from declared_cyclic c join declared_reach r on r.workflow = c.workflow and r.src = c.task
                                  where c.workflow = d.workflow and r.dst = d.task) then null
                     else coalesce((select cast(max(len(p.steps)) as int) from declared_chain p where p.workflow = d.workflow and p.task = d.task), 0) end as lvl
         from declared d) x group by lvl""".replace(
        "declared_chain p", """(with recursive chain(workflow, task, steps) as (
             select workflow, dst, [src] from declared_known k
               where not exists (select 1 from declared_known b where b.workflow = k.workflow and b.dst = k.src)
             union select c.workflow, k.dst, list_append(c.steps, c.task) from chain c
               join declared_known k on k.workflow = c.workflow and k.src = c.task
               where not list_contains(c.steps, k.dst) and k.dst <> c.task) select * from chain) p"""),
    ("declared", "declared_known", "declared_cyclic", "declared_reach"),
)
for _direction, _near, _far in (("dependents", "src", "dst"), ("dependencies", "dst", "src")):
    add(
        f"G4_{_direction}",
        lambda spark, sf, direction=_direction: dag.neighbours(t.edges(spark, sf), direction, KEY),
        f"select distinct run_id, {_near} as task, {_far} as neighbour from edges", ("edges",),
    )
add(
    "G4_neighbour_counts",
    lambda spark, sf: dag.neighbour_counts(t.nodes(spark, sf), t.edges(spark, sf), KEY),
    """select n.run_id, n.task, (select count(*) from edges e where e.run_id = n.run_id and e.dst = n.task) as dependencies,
              (select count(*) from edges e where e.run_id = n.run_id and e.src = n.task) as dependents
       from nodes n""",
    ("nodes", "edges"),
)


def _paths(spark, sf):
    pairs = t.nodes(spark, sf).withColumn("other", F.explode(F.array(F.lit(2), F.lit(3), F.col("task") - 1)))
    return dag.has_dependency_path(t.edges(spark, sf), pairs, KEY)


add(
    "G5_dependency_path", _paths,
    """select n.run_id, n.task, n.other, n.task = n.other or exists (
              select 1 from closure c where c.run_id = n.run_id and c.src = n.other and c.dst = n.task) as depends
       from (select run_id, task, unnest([2, 3, task - 1]) as other from nodes) n""".replace(
        "closure c", """(with recursive closure as (
             select run_id, src, dst from edges union
             select c.run_id, c.src, e.dst from closure c join edges e on e.run_id = c.run_id and e.src = c.dst) select * from closure) c"""),
    ("nodes", "edges"),
)
add(
    "G6_roots",
    lambda spark, sf: dag.dag_roots(t.nodes(spark, sf), t.edges(spark, sf), KEY),
    "select run_id, task from nodes n where not exists (select 1 from edges e where e.run_id = n.run_id and e.dst = n.task)",
    ("nodes", "edges"),
)
add(
    "G6_leaves",
    lambda spark, sf: dag.dag_leaves(t.nodes(spark, sf), t.edges(spark, sf), KEY),
    "select run_id, task from nodes n where not exists (select 1 from edges e where e.run_id = n.run_id and e.src = n.task)",
    ("nodes", "edges"),
)
add(
    "G7_self_dependencies",
    lambda spark, sf: dag.self_dependencies(dag.dag_edges(t.declared_tasks(spark, sf))),
    "select workflow, src as task from declared_edges where src = dst", ("declared_edges",),
)
add(
    "G8_no_root",
    lambda spark, sf: dag.workflows_without_root(*_declared(spark, sf)),
    "select workflow from declared group by workflow having min(len(deps)) > 0", ("declared",),
)
add(
    "G9_unreachable",
    lambda spark, sf: dag.dag_unreachable(*_declared(spark, sf)),
    "select workflow, task from declared_lost", ("declared_lost",),
)
add(
    "G10_shape",
    lambda spark, sf: dag.dag_shape(_levels(spark, sf), KEY),
    """select run_id, max(n) as max_parallelism, max(lvl) + 1 as depth, cast(sum(n) as bigint) as tasks
       from (select run_id, lvl, count(*) as n from levels group by run_id, lvl) x group by run_id""",
    ("levels",),
)


def _targets(spark, sf, pick):
    return t.nodes(spark, sf).groupBy(KEY).agg(pick("task").alias("task"))


for _name, _pick, _fn, _test in (
    ("G11_before", "max", "dag_before", "<"), ("G11_after", "min", "dag_after", ">"),
):
    add(
        _name,
        lambda spark, sf, pick=_pick, fn=_fn: getattr(dag, fn)(_levels(spark, sf), _targets(spark, sf, getattr(F, pick)), KEY),
        f"""select l.run_id, g.task as target, l.task, l.lvl from levels l
       join (select run_id, {_pick}(task) as task from nodes group by run_id) g on g.run_id = l.run_id
       join levels o on o.run_id = g.run_id and o.task = g.task where l.lvl {_test} o.lvl""",
        ("levels", "nodes"),
    )
add(
    "G11_order_counts",
    lambda spark, sf: dag.dag_order_counts(_levels(spark, sf), KEY),
    """select run_id, task, lvl, (select count(*) from levels b where b.run_id = l.run_id and b.lvl < l.lvl) as tasks_before,
              (select count(*) from levels b where b.run_id = l.run_id and b.lvl > l.lvl) as tasks_after
       from levels l""",
    ("levels",),
)


def _propagated(spark, sf):
    levels = _levels(spark, sf).withColumn("task", F.concat(F.lit("task_"), F.col("task").cast("string")))
    tasks = t.named_tasks(spark, sf, False).select(KEY, "workflow_name", "task_id", "status")
    return dag.skip_propagation(levels, tasks, t.workflow_tasks(spark, sf))


add(
    "G13_skip_propagation", _propagated,
    """select t.run_id, t.task_id, l.lvl, s.stop_level,
              case when s.stop_level is not null and l.lvl > s.stop_level then 'skipped' else t.status end as status
       from tasks t join levels l on l.run_id = t.run_id and l.task = t.ordinal
       left join (select n.run_id, min(l.lvl) as stop_level
                  from named_tasks n join definitions d on d.workflow_name = n.workflow_name and d.task_id = n.task_id and (d.required or d.workflow_name like '%3')
                  join levels l on l.run_id = n.run_id and l.task = n.ordinal
                  where n.status in ('failed','timeout','cancelled') group by n.run_id) s on s.run_id = t.run_id""",
    ("tasks", "levels", "named_tasks", "definitions"),
)
add(
    "J3_unknown_dependencies",
    lambda spark, sf: dag.unknown_dependencies(*_declared(spark, sf)),
    """select workflow, dst as task, src as dependency from declared_edges e
       where not exists (select 1 from declared d where d.workflow = e.workflow and d.task = e.src)""",
    ("declared", "declared_edges"),
)

# Definition checks ----------------------------------------------------------------------


def _issues(spark, sf):
    workflows, definitions = t.declared_workflows(spark, sf), stored(t.declared_tasks(spark, sf), "definitions")
    return workflows, validation.definition_issues(workflows, definitions)


add(
    "A14_definition_issues",
    lambda spark, sf: _issues(spark, sf)[1].select("workflow", "task", "ordinal", "severity", "kind", "message"),
    "select workflow, task, ordinal, severity, kind, message from issues", ("issues",),
)
add(
    "A14_validate_definitions",
    lambda spark, sf: validation.validate_definitions(*_issues(spark, sf)),
    """select w.workflow, count(*) filter (i.severity = 'error') as errors, count(*) filter (i.severity = 'warning') as warnings,
              count(*) filter (i.severity = 'error') = 0 as is_valid
       from workflows w left join issues i on i.workflow = w.workflow group by w.workflow""",
    ("workflows", "issues"),
)


def _messages(spark, sf):
    pages = validation.validation_messages(_issues(spark, sf)[1])
    return pages.select(
        "workflow", "page", F.array_join(F.array_sort("errors"), " | ").alias("errors"),
        F.array_join(F.array_sort("warnings"), " | ").alias("warnings"),
    )


add(
    "A14_validation_messages", _messages,
    """select workflow, cast(0 as bigint) as page,
              coalesce(string_agg(message, ' | ' order by message) filter (severity = 'error'), '') as errors,
              coalesce(string_agg(message, ' | ' order by message) filter (severity = 'warning'), '') as warnings
       from issues group by workflow""",
    ("issues",),
)
add(
    "A15_duplicate_names",
    lambda spark, sf: validation.duplicate_names(t.declared_tasks(spark, sf)),
    """select workflow, coalesce(name, task) as name, count(*) as uses, min(ordinal) as ordinal from declared
       group by workflow, coalesce(name, task) having count(*) > 1""",
    ("declared",),
)
add(
    "A15_workflow_issues",
    lambda spark, sf: validation.workflow_issues(t.declared_workflows(spark, sf), t.declared_tasks(spark, sf)).select(
        "workflow", "kind", "message"
    ),
    "select workflow, kind, message from issues where kind in ('name', 'output', 'empty')", ("issues",),
)
add(
    "A16_config_issues",
    lambda spark, sf: validation.config_issues(t.declared_tasks(spark, sf)).filter("kind <> 'template'").select(
        "workflow", "task", "kind", "message"
    ),
    "select workflow, task, kind, message from config_issues", ("config_issues",),
)
add(
    "F17_brace_error",
    lambda spark, sf: t.load(spark, sf, "pages").select("page_id", tx.brace_error("html").alias("problem")),
    r"""select page_id, case when regexp_full_match(b, '(\{(\{\})*\})*') then null
              when regexp_matches(b, '^(\{(\{\})*\})*\}') then 'unmatched closing brace'
              when regexp_matches(b, '^(\{(\{\})*\})*\{(\{\})*\{\{') then 'nested template expressions not allowed'
              else 'unmatched template braces' end as problem
       from (select page_id, regexp_replace(html, '[^{}]', '', 'g') as b from pages) x""",
)
add(
    "F17_brace_error_in_conditions",
    lambda spark, sf: t.declared_tasks(spark, sf).select("workflow", "task", tx.brace_error("when").alias("problem")),
    "select workflow, task, problem from braces", ("braces",),
)
