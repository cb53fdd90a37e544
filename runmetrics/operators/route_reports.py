"""Reports made the way their route says: its generator, filters, variables and template.

Routes are configuration, a short list held by the driver, and so are their template texts. All template routes become
one pass over the rows: the text of a row's route is chosen by a column expression.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.template import render
from ..functions.times import next_period, rfc3339
from . import reports, routing
from .results import nested_summary

TEMPLATE = "template"
# What a template can name beside the whole row: its columns by kind of data.
NAMES = {
    "run": ("workflow_name", "run_id", "status", "success_rate", "total_tasks", "failed_tasks"),
    "task": ("task_id", "task_type", "status", "workflow_name", "run_id", "error", "output"),
    "period": ("total_workflows", "successful_workflows", "failed_workflows", "workflow_success_rate", "total_tasks", "task_success_rate"),
}
ROWS = {"run": ("workflow", "metrics"), "task": ("task",), "period": ("metrics",)}
KEYS = {"run": ("run_id",), "task": ("run_id", "task_id"), "period": ("period_start",)}
COUNTERS = ("total_tasks", "successful_tasks", "failed_tasks", "skipped_tasks", "success_rate")
COLUMNS = ("route", "page", "report_type", "title", "content", "metadata", "generated_at")


def route_texts(routes: Sequence[routing.Route], named: Mapping[str, str] | None = None, read: Callable[[str], str] | None = None) -> dict[str, str]:
    """The template text of each route: its own, else the one of its name, else its file's as ``read`` gives it."""
    texts = {}
    for r in routes:
        if r.template_content is not None:
            texts[r.name] = r.template_content
        elif r.name in (named or {}):
            texts[r.name] = named[r.name]
        elif r.template_file is not None and read is not None:
            texts[r.name] = read(r.template_file)
        else:
            raise ValueError(f"no template content found for route {r.name!r}")
    return texts


def template_context(rows: DataFrame, data: str, at: Column, period: str | None = None) -> DataFrame:
    """The names that templates see, beside the keys, the title's columns and ``route``.

    The whole row is ``workflow`` and ``metrics``, ``task`` or ``metrics``, by the kind of data; a run has its counters
    in ``workflow.summary``, too. A column that the rows lack is absent.
    """
    own = [c for c in rows.columns if c != "route"]
    row = [F.col(f"`{c}`").alias(c) for c in own]
    counters = [F.col(c) for c in COUNTERS if c in own]
    names = {c: F.col(c) for c in (*KEYS[data], *NAMES[data]) if c in own}
    for name in ROWS[data]:
        names[name] = F.struct(*row, F.struct(*counters).alias("summary")) if name == "workflow" and counters else F.struct(*row)
    if data == "task":
        names["workflow_context"] = F.struct(*[F.col(c) for c in ("workflow_name", "run_id") if c in own])
    if data == "period":
        names |= {"period": F.lit(reports.PERIOD_TITLES[period]), "generated_at": rfc3339(at)}
    names |= {"timestamp": rfc3339(at), "date": F.date_format(at, "yyyy-MM-dd"), "time": F.date_format(at, "HH:mm:ss")}
    return rows.select("route", *[value.alias(name) for name, value in names.items()])


def report_templates(
    rows: DataFrame, data: str, routes: Sequence[routing.Route], texts: Mapping[str, str],
    variables: Mapping[str, str] | None = None, at: Column | None = None, period: str | None = None,
) -> DataFrame:
    """A report for every row by the template of its route (column ``route``); rows of other routes are left out.

    ``variables`` are known to all templates; those of a route replace them, and what the row has replaces both. A
    variable ``title`` is the title.
    """
    at = F.current_timestamp() if at is None else at
    seen = template_context(rows.filter(F.col("route").isin(*texts)), data, at, period)
    title = content = metadata = None
    for r in routes:
        merged = {**(variables or {}), **r.variables}
        context = {k: F.lit(v) for k, v in merged.items() if k not in seen.columns}
        context |= {"template_name": F.lit(r.name), "generator_type": F.lit(r.generator_type)}
        made = (
            reports.template_title(data, merged.get("title"), r.name, period), render(seen, texts[r.name], context),
            reports.template_metadata(data, r.name, r.generator_type, at, r.variables, period),
        )
        if title is None:
            title, content, metadata = (F.when(F.col("route") == r.name, value) for value in made)
        else:
            title, content, metadata = (chain.when(F.col("route") == r.name, value) for chain, value in zip((title, content, metadata), made))
    if title is None:
        raise ValueError("no routes")
    return reports._reports(seen, [*KEYS[data], "route"], TEMPLATE, title, content, metadata, at)


def _filtered(tasks: DataFrame, filters: routing.Filters) -> DataFrame:
    return tasks.filter(routing.task_filter(filters))


def _made(
    generator: str, data: str, routes: Sequence[routing.Route], rows: DataFrame, tasks: DataFrame | None, at: Column, period: str | None,
) -> list[DataFrame]:
    """Reports of the routes of one generator that isn't a template."""
    out = []
    for r in routes:
        own = rows.filter(F.col("route") == r.name).drop("route")
        if data == "period":
            made = reports.generate_reports(generator, data, metrics=own, period=period, template=r.name, at=at)
        elif data == "task":
            made = reports.generate_reports(generator, data, tasks=_filtered(own, r.filters), template=r.name, at=at)
        elif generator == "detailed":
            made = reports.generate_reports(generator, data, runs=own, tasks=tasks.join(own.select("run_id"), "run_id", "left_semi"), filters=r.filters, template=r.name, at=at)
        else:
            made = reports.generate_reports(generator, data, runs=own, tasks=tasks, template=r.name, at=at)
        out.append(made.withColumn("route", F.lit(r.name)))
    return out


def report_routes(
    data: str, rows: DataFrame, routes: Sequence[routing.Route], tasks: DataFrame | None = None,
    named: Mapping[str, str] | None = None, variables: Mapping[str, str] | None = None, at: Column | None = None,
    read: Callable[[str], str] | None = None, switches: routing.Switches = routing.Switches(), period: str | None = None,
) -> DataFrame:
    """Reports of finished runs (``data`` run, with their ``tasks``), failed tasks (task) or metrics of periods (period).

    One per triggered route, by its generator, filters, variables and template; routes for another ``period`` than the one
    of the metrics make none. Long detailed reports have several pages. There are none where ``switches`` turn the kind
    off. Failed tasks and periods are reported row by row, so they may also be a stream.
    """
    if data not in KEYS:
        raise ValueError(f"routes are triggered by run, task or period data, not {data!r}")
    if data == "period" and period not in reports.PERIOD_TITLES:
        raise ValueError(f"unknown period {period!r}")
    if data == "period":
        routes = routing.routes_for_period(routes, period)
        if "period_end" not in rows.columns:
            rows = rows.withColumn("period_end", next_period(F.col("period_start"), period))
    at = F.current_timestamp() if at is None else at
    if not switches.of(data):
        rows = rows.filter(F.lit(False))
    trigger = {
        "run": routing.runs_triggering, "task": routing.tasks_triggering,
        "period": lambda metrics, routes: routing.periods_triggering(metrics, routes, period),
    }[data]
    parts = []
    for generator in sorted({r.generator_type for r in routes}):
        own = [r for r in routes if r.generator_type == generator]
        triggered = trigger(rows, own)
        if generator == TEMPLATE:
            parts.append(report_templates(triggered, data, own, route_texts(own, named, read), variables, at, period))
        else:
            parts += _made(generator, data, own, triggered, tasks, at, period)
    if not parts:
        raise ValueError("no routes")
    paged = [p if "page" in p.columns else p.withColumn("page", F.lit(0).cast("long")) for p in parts]
    return reduce(DataFrame.unionByName, [p.select(*KEYS[data], *COLUMNS) for p in paged])


def report_nested_routes(
    nested: DataFrame, routes: Sequence[routing.Route], named: Mapping[str, str] | None = None,
    variables: Mapping[str, str] | None = None, at: Column | None = None, read: Callable[[str], str] | None = None,
    switches: routing.Switches = routing.Switches(),
) -> DataFrame:
    """The same for runs that carry their tasks: row by row, so it also works on a stream.

    Detailed reports show the tasks that pass the filters of their route.
    """
    at = F.current_timestamp() if at is None else at
    if not switches.of("run"):
        nested = nested.filter(F.lit(False))
    parts = []
    for generator in sorted({r.generator_type for r in routes}):
        own = [r for r in routes if r.generator_type == generator]
        triggered = routing.runs_triggering(nested, own)
        if generator == TEMPLATE:
            parts.append(report_templates(triggered.select("*", *nested_summary("tasks")), "run", own, route_texts(own, named, read), variables, at))
        elif generator == "detailed":
            for r in own:
                parts.append(reports.report_nested_detailed(triggered.filter(F.col("route") == r.name), at=at, filters=r.filters))
        elif generator in reports.NESTED_GENERATORS:
            parts.append(reports.NESTED_GENERATORS[generator](triggered, at=at))
        else:
            raise ValueError(f"generator {generator!r} cannot report nested runs; generators: {sorted([*reports.NESTED_GENERATORS, TEMPLATE])}")
    if not parts:
        raise ValueError("no routes")
    return reduce(DataFrame.unionByName, parts)


for _data in KEYS:
    reports.register_generator(TEMPLATE, _data, lambda rows, routes, texts, _data=_data, **o: report_templates(rows, _data, routes, texts, **o))
