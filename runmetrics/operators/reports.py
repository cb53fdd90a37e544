"""Report tables: one row per report with type, title, content and metadata.

Texts are built by column expressions. Only two places gather several rows in one value:
the first five failures of a run, and a page of at most ``per_page`` task entries of a
detailed report. A run with more tasks gets more pages, so nothing is cut off and no
group grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import status as st
from ..functions import text as tx
from ..functions.maps import literal_map
from ..functions.template import fill
from ..functions.times import PERIOD_UNITS, clock_text, fixed_text, rfc3339, seconds_text
from .results import nested_summary
from .routing import Filters, outcome_filter, task_filter
from .windows import top_n_per_key

# Layouts of the texts.
SHOWN_FAILURES = 5
UNKNOWN_ERROR = "Unknown error"

RUN_SUMMARY = (
    "{{icon}} **Workflow Summary**\n\n**Workflow:** {{name}}\n**Run ID:** {{run}}\n"
    "**Status:** {{status}}{{took}}\n**Started:** {{started}}\n{{completed}}"
    "\n**Task Summary:**\n- Total: {{total}}\n- Successful: {{ok}} ({{rate}}%)\n- Failed: {{bad}}\n- Skipped: {{skipped}}\n"
    "{{failures}}"
)
FAILURES_HEADING = "\n**Failed Tasks:**\n"
FAILURE_LINE = "- {{task}} ({{type}}): {{error}}\n"
MORE_FAILURES = "- ... and {{more}} more\n"
TASK_SUMMARY = (
    "{{icon}} **Task Summary**\n\n**Task:** {{task}}\n**Type:** {{type}}\n**Workflow:** {{name}} ({{run}})\n"
    "**Status:** {{status}}{{took}}\n**Started:** {{started}}\n{{completed}}{{retries}}{{output}}{{error}}"
)
PERIOD_SUMMARY = (
    "📊 **{{period}} Metrics Summary**\n\n**Period:** {{start}} to {{end}}\n**Generated:** {{generated}}\n\n"
    "**Workflow Statistics:**\n- Total workflows: {{runs}}\n- Successful: {{runs_ok}} ({{runs_rate}}%)\n- Failed: {{runs_bad}}\n"
    "{{runs_average}}\n**Task Statistics:**\n- Total tasks: {{tasks}}\n- Successful: {{tasks_ok}} ({{tasks_rate}}%)\n"
    "- Failed: {{tasks_bad}}\n- Skipped: {{tasks_skipped}}\n- Cancelled: {{tasks_cancelled}}\n{{tasks_average}}"
)
AVERAGE_LINE = "- Average duration: {{seconds}}s\n"
RUN_DETAILED = (
    "# Workflow Execution Report\n\n## Overview\n- **Workflow Name:** {{name}}\n- **Run ID:** {{run}}\n"
    "- **Status:** {{status}}\n- **Started:** {{started}}\n{{completed}}{{duration}}"
    "\n## Task Statistics\n- **Total Tasks:** {{total}}\n- **Successful:** {{ok}} ({{rate}}%)\n- **Failed:** {{bad}}\n"
    "- **Skipped:** {{skipped}}\n- **Success Rate:** {{rate}}%\n{{heading}}"
)
DETAILS_HEADING = "\n## Task Details\n\n"
TASK_ENTRY = (
    "### {{icon}} {{task}} ({{type}})\n- **Status:** {{status}}\n- **Started:** {{started}}\n"
    "{{completed}}{{duration}}{{retries}}{{output}}{{error}}{{metadata}}\n"
)
TASK_DETAILED = (
    "# Task Execution Report\n\n## {{icon}} Task: {{task}}\n\n### Overview\n- **Task ID:** {{task}}\n- **Task Type:** {{type}}\n"
    "- **Status:** {{status}}\n- **Workflow:** {{name}} (Run: {{run}})\n- **Started:** {{started}}\n"
    "{{completed}}{{duration}}{{retries}}\n### Execution Details\n{{output}}{{error}}{{metadata}}{{context}}"
)
LISTING_RUN = (
    "Workflow: {{name}} ({{run}})\nStatus: {{status}}\n{{started}}{{completed}}{{duration}}\nSummary:\n"
    "  Total tasks: {{total}}\n  Successful: {{ok}}\n  Failed: {{bad}}\n  Skipped: {{skipped}}\n  Success rate: {{rate}}%\n{{heading}}"
)
LISTING_HEADING = "\nTasks:\n"
LISTING_TASK = "{{icon}} {{task}} ({{type}}){{duration}}{{retries}}{{output}}{{error}}"
SEPARATOR = "\n--- {{at}} ---\n"
PERIOD_TITLES = {"hourly": "Hourly", "daily": "Daily", "weekly": "Weekly", "monthly": "Monthly"}


def _when(test: Column, text: Column) -> Column:
    return F.when(test, text).otherwise("")


def _line(layout: str, value: Column, shown: Column | None = None) -> Column:
    """The layout filled with ``value``, or nothing when the value is null."""
    return _when(value.isNotNull(), fill(layout, x=value if shown is None else shown))


def _fenced(heading: str, value: Column) -> Column:
    return _line("\n**" + heading + ":**\n```\n{{x}}\n```\n", value)


def _metadata_lines(heading: str, metadata: Column, layout: str) -> Column:
    entries = F.array_sort(F.map_entries(metadata))
    lines = F.transform(entries, lambda e: fill(layout, key=e["key"], value=e["value"]))
    return _when(F.coalesce(F.size(metadata), F.lit(0)) > 0, F.concat(F.lit(heading), F.array_join(lines, "")))


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _first_failures(tasks: DataFrame, k: int, key: str, ordinal: str) -> DataFrame:
    """(key, lines): the first k failures of every run, in order. At most k rows per run are gathered."""
    failed = tasks.filter(st.is_failed("status"))
    line = fill(FAILURE_LINE, task="task_id", type="task_type", error=F.coalesce("error", F.lit(UNKNOWN_ERROR)))
    first = top_n_per_key(failed.select(key, F.col(ordinal).alias("o"), line.alias("line")), [key], [F.col("o")], k)
    gathered = F.array_sort(F.collect_list(F.struct("o", "line")))
    return first.groupBy(key).agg(F.transform(gathered, lambda e: e["line"]).alias("lines"))


def _digest(lines: Column, failures: Column, k: int) -> Column:
    return F.concat(
        F.lit(FAILURES_HEADING), F.array_join(lines, ""), _when(failures > k, fill(MORE_FAILURES, more=failures - k))
    )


def failed_task_digest(tasks: DataFrame, k: int = SHOWN_FAILURES, key: str = "run_id", ordinal: str = "ordinal") -> DataFrame:
    """First k failures of every run as text, with the number of those left out."""
    counts = tasks.filter(st.is_failed("status")).groupBy(key).agg(F.count("*").alias("failures"))
    return counts.join(_first_failures(tasks, k, key, ordinal), key).select(
        key, "failures", _digest(F.col("lines"), F.col("failures"), k).alias("digest")
    )


def _reports(df: DataFrame, keys: Sequence[str], kind: str, title: Column, content: Column, metadata: Column, at: Column) -> DataFrame:
    return df.select(
        *keys, F.lit(kind).alias("report_type"), title.alias("title"), content.alias("content"),
        metadata.alias("metadata"), at.alias("generated_at"),
    )


def _metadata(kind: str, template: str, **values: Column) -> Column:
    pairs = {"generator": F.lit(kind), "template": F.lit(template), **values}
    return F.create_map(*[x for name, value in pairs.items() for x in (F.lit(name), value.cast("string"))])


def _took(duration: Column) -> Column:
    return _line(" (took {{x}}s)", duration, seconds_text(duration, 1))


def _run_summaries(rows: DataFrame, template: str, at: Column | None) -> DataFrame:
    content = fill(
        RUN_SUMMARY,
        icon=st.icon("status", st.RUN_ICONS), name="workflow_name", run="run_id", status="status",
        took=_took(F.col("duration_ms")), started=clock_text("start_time"),
        completed=_line("**Completed:** {{x}}\n", clock_text("end_time")),
        total="total_tasks", ok="successful_tasks", rate=fixed_text("success_rate", 1), bad="failed_tasks",
        skipped="skipped_tasks", failures="digest",
    )
    title = fill("Workflow Summary: {{n}} - {{s}}", n="workflow_name", s="status")
    metadata = _metadata("summary", template, workflow_name=F.col("workflow_name"), run_id=F.col("run_id"), status=F.col("status"))
    keys = [c for c in ("run_id", "route") if c in rows.columns]
    return _reports(rows, keys, "summary", title, content, metadata, F.current_timestamp() if at is None else at)


def report_run_summary(runs: DataFrame, tasks: DataFrame, template: str = "default", at: Column | None = None) -> DataFrame:
    """Summary report of every run; ``runs`` as made by ``run_facts``."""
    first = _first_failures(tasks, SHOWN_FAILURES, "run_id", "ordinal")
    # The counters of the run already say how many failures there are.
    failures = F.col("failed_tasks") + F.col("cancelled_tasks")
    digest = _digest(F.col("lines"), failures, SHOWN_FAILURES)
    rows = runs.join(first, "run_id", "left").withColumn("digest", _when(F.col("lines").isNotNull(), digest))
    return _run_summaries(rows, template, at)


def report_nested_summary(nested: DataFrame, template: str = "default", at: Column | None = None) -> DataFrame:
    """The same report for runs that carry their tasks: row by row, so it also works on a stream."""

    def line(task: Column) -> Column:
        return fill(FAILURE_LINE, task=task["task_id"], type=task["task_type"],
                    error=F.coalesce(task["error"], F.lit(UNKNOWN_ERROR)))

    failed = F.filter("tasks", lambda task: st.is_failed(task["status"]))
    digest = _digest(F.transform(F.slice(failed, 1, SHOWN_FAILURES), line), F.size(failed), SHOWN_FAILURES)
    rows = nested.select("*", *nested_summary("tasks")).withColumn("digest", _when(F.size(failed) > 0, digest))
    return _run_summaries(rows, template, at)


def report_nested_detailed(nested: DataFrame, template: str = "default", at: Column | None = None, filters: Filters = Filters()) -> DataFrame:
    """The detailed report of runs that carry their tasks, row by row; the run's entries are as long as its tasks are.

    Entries are made for the tasks that pass ``filters``; the counts of the head are those of all tasks.
    """

    def entry(task: Column) -> Column:
        def has(name: str) -> bool:
            return name in names

        def value(name: str, kind: str = "string") -> Column:
            return task[name] if has(name) else F.lit(None).cast(kind)

        return fill(
            TASK_ENTRY, icon=st.icon(task["status"], st.TASK_DETAIL_ICONS), task=task["task_id"], type=task["task_type"], status=task["status"],
            started=F.coalesce(clock_text(value("start_time", "timestamp")), F.lit("")),
            completed=_line("- **Completed:** {{x}}\n", clock_text(value("end_time", "timestamp"))),
            duration=_line("- **Duration:** {{x}} seconds\n", value("duration_ms", "long"), seconds_text(value("duration_ms", "long"), 2)),
            retries=_when(F.coalesce(value("retry_count", "int"), F.lit(0)) > 0, fill("- **Retries:** {{n}}\n", n=value("retry_count", "int"))),
            output=_fenced("Output", value("output")), error=_fenced("Error", value("error")),
            metadata=_metadata_lines("\n**Metadata:**\n", value("metadata", "map<string,string>"), "- {{key}}: {{value}}\n"),
        )

    names = set(nested.schema["tasks"].dataType.elementType.names)
    rows = nested.select("*", *nested_summary("tasks"))
    head = _detailed_head()
    foot = _metadata_lines("## Workflow Metadata\n", _optional(nested, "metadata", "map<string,string>"), "- {{key}}: {{value}}\n")
    tasks = F.coalesce("tasks", F.array().cast(nested.schema["tasks"].dataType))
    shown = F.filter(tasks, lambda task: F.coalesce(task_filter(filters, lambda name: task[name]), F.lit(False)))
    content = F.concat(head, F.array_join(F.transform(shown, entry), ""), F.coalesce(foot, F.lit("")))
    title = fill("Detailed Workflow Report: {{n}} - {{s}}", n="workflow_name", s="status")
    metadata = _metadata("detailed", template, workflow_name=F.col("workflow_name"), run_id=F.col("run_id"), task_count=F.col("total_tasks"))
    keys = [c for c in ("run_id", "route") if c in rows.columns]
    return _reports(rows, keys, "detailed", title, content, metadata, F.current_timestamp() if at is None else at)


NESTED_GENERATORS = {"summary": report_nested_summary, "detailed": report_nested_detailed}


def report_task_summary(tasks: DataFrame, template: str = "default", at: Column | None = None) -> DataFrame:
    """Summary report of every task; long outputs are shown up to 200 characters."""
    content = fill(
        TASK_SUMMARY,
        icon=st.icon("status", st.TASK_ICONS), task="task_id", type="task_type", name="workflow_name",
        run="run_id", status="status", took=_took(F.col("duration_ms")), started=clock_text("start_time"),
        completed=_line("**Completed:** {{x}}\n", clock_text(_optional(tasks, "end_time", "timestamp"))),
        retries=_when(F.col("retry_count") > 0, fill("**Retries:** {{n}}\n", n="retry_count")),
        output=_fenced("Output", tx.truncate_text(_optional(tasks, "output"), tx.TASK_OUTPUT_LIMIT)),
        error=_fenced("Error", _optional(tasks, "error")),
    )
    title = fill("Task Summary: {{t}} in {{w}} - {{s}}", t="task_id", w="workflow_name", s="status")
    metadata = _metadata(
        "summary", template, task_id=F.col("task_id"), task_type=F.col("task_type"),
        workflow_name=F.col("workflow_name"), status=F.col("status"),
    )
    return _reports(tasks, ["run_id", "task_id"], "summary", title, content, metadata, F.current_timestamp() if at is None else at)


def _period_content(period: str, at: Column) -> Column:
    def average(name: str) -> Column:
        return _when(F.col(name).isNotNull(), fill(AVERAGE_LINE, seconds=seconds_text(name, 1)))

    return fill(
        PERIOD_SUMMARY,
        period=F.lit(PERIOD_TITLES[period]), start=clock_text("period_start"), end=clock_text("period_end"),
        generated=clock_text(at), runs="total_workflows", runs_ok="successful_workflows",
        runs_rate=fixed_text("workflow_success_rate", 1), runs_bad="failed_workflows",
        runs_average=average("avg_workflow_duration_ms"), tasks="total_tasks", tasks_ok="successful_tasks",
        tasks_rate=fixed_text("task_success_rate", 1), tasks_bad="failed_tasks", tasks_skipped="skipped_tasks",
        tasks_cancelled="cancelled_tasks", tasks_average=average("avg_task_duration_ms"),
    )


def report_period(metrics: DataFrame, period: str, template: str = "default", at: Column | None = None, kind: str = "summary") -> DataFrame:
    """Report of every metrics row (see ``execution_metrics``); the detailed kind has the same text."""
    at = F.current_timestamp() if at is None else at
    label = f"{PERIOD_TITLES[period]} {template} Report"
    title = F.lit(label if kind == "summary" else f"Detailed {label}")
    metadata = _metadata(kind, template, period=F.lit(PERIOD_TITLES[period]))
    return _reports(metrics, ["period_start"], kind, title, _period_content(period, at), metadata, at)


def report_metrics_json(metrics: DataFrame, period: str, at: Column | None = None) -> DataFrame:
    """Metrics rows as JSON."""
    at = F.current_timestamp() if at is None else at
    content = F.to_json(F.struct(*[F.col(c) for c in metrics.columns]), {"ignoreNullFields": "false"})
    title = F.lit(f"Metrics Report - {PERIOD_TITLES[period]}")
    return _reports(metrics, ["period_start"], "metrics", title, content, literal_map({}), at)


def _task_parts(df: DataFrame, retries: str, error: str) -> dict[str, Column]:
    end = _optional(df, "end_time", "timestamp")
    return {
        "started": clock_text("start_time"),
        "completed": _line("- **Completed:** {{x}}\n", clock_text(end)),
        "duration": _line("- **Duration:** {{x}} seconds\n", F.col("duration_ms"), seconds_text("duration_ms", 2)),
        "retries": _when(F.col("retry_count") > 0, fill("- **" + retries + ":** {{n}}\n", n="retry_count")),
        "output": _fenced("Output", _optional(df, "output")),
        "error": _fenced(error, _optional(df, "error")),
    }


def task_entries(tasks: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """(run_id, ordinal, text): the entry of every shown task in its run's detailed report."""
    metadata = _optional(tasks, "metadata", "map<string,string>")
    text = fill(
        TASK_ENTRY, icon=st.icon("status", st.TASK_DETAIL_ICONS), task="task_id", type="task_type", status="status",
        metadata=_metadata_lines("\n**Metadata:**\n", metadata, "- {{key}}: {{value}}\n"),
        **_task_parts(tasks, "Retries", "Error"),
    )
    return tasks.filter(task_filter(filters)).select("run_id", F.col("ordinal").cast("long").alias("ordinal"), text.alias("text"))


def _pages(head: DataFrame, entries: DataFrame, last: DataFrame, foot: DataFrame | None, per_page: int) -> DataFrame:
    """Put head, entries and foot of every run together, ``per_page`` ordinals per page.

    ``last`` has (run_id, last): the largest ordinal of the run, which fixes its last page.
    """
    rows = [
        head.select("run_id", F.lit(0).cast("long").alias("page"), F.lit(-1).cast("long").alias("ordinal"), "text"),
        entries.select("run_id", F.floor(F.col("ordinal") / per_page).alias("page"), "ordinal", "text"),
    ]
    if foot is not None:
        end = F.coalesce(F.col("last"), F.lit(0))
        rows.append(
            foot.join(last, "run_id", "left").select(
                "run_id", F.floor(end / per_page).alias("page"), (end + 1).cast("long").alias("ordinal"), "text"
            )
        )
    everything = rows[0]
    for more in rows[1:]:
        everything = everything.unionByName(more)
    # Bounded: at most per_page entries plus head and foot.
    gathered = everything.groupBy("run_id", "page").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("l"))
    return gathered.select("run_id", "page", F.array_join(F.transform("l", lambda e: e["text"]), "").alias("content"))


def _last_ordinal(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("run_id").agg(F.max("ordinal").cast("long").alias("last"))


def _detailed_head() -> Column:
    return fill(
        RUN_DETAILED, name="workflow_name", run="run_id", status="status", started=clock_text("start_time"),
        completed=_line("- **Completed:** {{x}}\n", clock_text("end_time")),
        duration=_line("- **Duration:** {{x}} seconds\n", F.col("duration_ms"), seconds_text("duration_ms", 2)),
        total="total_tasks", ok="successful_tasks", rate=fixed_text("success_rate", 1), bad="failed_tasks",
        skipped="skipped_tasks", heading=_when(F.col("total_tasks") > 0, F.lit(DETAILS_HEADING)),
    )


def report_run_detailed(
    runs: DataFrame, tasks: DataFrame, filters: Filters = Filters(), template: str = "default",
    at: Column | None = None, per_page: int = 500,
) -> DataFrame:
    """Detailed report of every run, in numbered pages; most runs have one."""
    text = _detailed_head()
    foot = None
    if "metadata" in runs.columns:
        lines = _metadata_lines("## Workflow Metadata\n", F.col("metadata"), "- {{key}}: {{value}}\n")
        foot = runs.select("run_id", lines.alias("text")).filter(F.col("text") != "")
    pages = _pages(runs.select("run_id", text.alias("text")), task_entries(tasks, filters), _last_ordinal(tasks), foot, per_page)
    facts = runs.select("run_id", "workflow_name", "status", "total_tasks")
    title = fill("Detailed Workflow Report: {{n}} - {{s}}", n="workflow_name", s="status")
    metadata = _metadata("detailed", template, workflow_name=F.col("workflow_name"), run_id=F.col("run_id"), task_count=F.col("total_tasks"))
    return _reports(
        pages.join(facts, "run_id"), ["run_id", "page"], "detailed", title, F.col("content"), metadata,
        F.current_timestamp() if at is None else at,
    )


def report_task_detailed(tasks: DataFrame, template: str = "default", at: Column | None = None) -> DataFrame:
    own = _optional(tasks, "metadata", "map<string,string>")
    context = _optional(tasks, "run_metadata", "map<string,string>")
    layout = "- **{{key}}:** {{value}}\n"
    content = fill(
        TASK_DETAILED, icon=st.icon("status", st.TASK_DETAIL_ICONS), task="task_id", type="task_type", status="status",
        name="workflow_name", run="run_id",
        metadata=_metadata_lines("\n### Task Metadata\n", own, layout),
        context=_metadata_lines("\n### Workflow Context\n", context, layout),
        **_task_parts(tasks, "Retry Count", "Error Details"),
    )
    title = fill("Detailed Task Report: {{t}} in {{w}} - {{s}}", t="task_id", w="workflow_name", s="status")
    metadata = _metadata("detailed", template, task_id=F.col("task_id"), task_type=F.col("task_type"), workflow_name=F.col("workflow_name"))
    return _reports(tasks, ["run_id", "task_id"], "detailed", title, content, metadata, F.current_timestamp() if at is None else at)


def listing_entry(
    task: Callable[[str], Column], include_duration: bool = True, max_output_length: int | None = None
) -> Column:
    """One task of the plain listing. ``task`` gives the field of a name."""
    output = task("output")
    if max_output_length is not None:
        output = tx.truncate_text(output, max_output_length, tx.LISTING_MARKER)
    indented = F.replace(output, F.lit("\n"), F.lit("\n    "))
    return fill(
        LISTING_TASK, icon=st.icon(task("status"), st.LISTING_ICONS), task=task("task_id"), type=task("task_type"),
        duration=_line(" [{{x}}s]", task("duration_ms"), seconds_text(task("duration_ms"), 2)) if include_duration else F.lit(""),
        retries=_when(task("retry_count") > 0, fill(" (retried {{n}} times)", n=task("retry_count"))),
        output=_when(F.coalesce(output, F.lit("")) != "", fill("\n    Output: {{o}}", o=indented)),
        error=_line("\n    Error: {{x}}", task("error")),
    )


def format_text(
    runs: DataFrame, tasks: DataFrame, include_timestamps: bool = True, include_duration: bool = True,
    successful: bool = False, failed: bool = False, max_output_length: int | None = None, per_page: int = 500,
) -> DataFrame:
    """The plain text listing of every run, in numbered pages."""
    no = F.lit("")
    head = fill(
        LISTING_RUN, name="workflow_name", run="run_id", status="status",
        started=fill("Started: {{x}}\n", x=clock_text("start_time")) if include_timestamps else no,
        completed=_line("Completed: {{x}}\n", clock_text("end_time")) if include_timestamps else no,
        duration=_line("Duration: {{x}}s\n", F.col("duration_ms"), seconds_text("duration_ms", 2)) if include_duration else no,
        total="total_tasks", ok="successful_tasks", bad="failed_tasks", skipped="skipped_tasks",
        rate=fixed_text("success_rate", 1), heading=_when(F.col("total_tasks") > 0, F.lit(LISTING_HEADING)),
    )
    entry = listing_entry(
        lambda n: _optional(tasks, n), include_duration, max_output_length
    )
    indented = F.concat(F.lit("  "), F.replace(entry, F.lit("\n"), F.lit("\n  ")), F.lit("\n\n"))
    entries = tasks.filter(outcome_filter("status", successful, failed)).select(
        "run_id", F.col("ordinal").cast("long").alias("ordinal"), indented.alias("text")
    )
    return _pages(runs.select("run_id", head.alias("text")), entries, _last_ordinal(tasks), None, per_page)


def template_title(data: str, custom: str | None = None, template: str = "default", period: str | None = None) -> Column:
    """Title of a report made from a template, for ``data`` in run, task or period."""
    if custom is not None:
        return F.lit(custom)
    if data == "run":
        base = fill("{{w}} - Workflow {{s}} Report", w="workflow_name", s="status")
    elif data == "task":
        base = fill("{{w}} - Task {{s}} Report", w="workflow_name", s="status")
    else:
        base = F.lit(f"{PERIOD_TITLES[period]} Metrics Report")
    return base if template in ("", "default") else F.concat(F.lit(f"{template} - "), base)


def template_metadata(
    data: str, template: str, generator: str, at: Column, variables: Mapping[str, str] | None = None,
    period: str | None = None,
) -> Column:
    values: dict[str, Column] = {
        "template_name": F.lit(template), "generator_type": F.lit(generator), "generated_at": rfc3339(at),
        "data_type": F.lit({"run": "workflow_completion", "task": "task_completion"}.get(data, "periodic_metrics")),
    }
    if data == "run":
        values |= {"workflow_name": F.col("workflow_name"), "run_id": F.col("run_id").cast("string")}
    elif data == "task":
        values |= {"task_id": F.col("task_id"), "workflow_name": F.col("workflow_name")}
    else:
        values["period"] = F.lit(PERIOD_TITLES[period])
    values |= {f"template_var_{k}": F.lit(v) for k, v in (variables or {}).items()}
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def message_text(limit: int = tx.MESSAGE_LIMIT) -> Column:
    """Chat message of a report: icon, title and the start of its content."""
    return fill(
        "{{icon}} *{{title}}*\n\n{{content}}",
        icon=st.icon("report_type", st.REPORT_TYPE_ICONS, st.OTHER_REPORT_ICON), title="title",
        content=tx.truncate_text("content", limit, tx.MESSAGE_MARKER),
    )


def report_payload(reports: DataFrame) -> DataFrame:
    """Report rows with the JSON bodies a chat message and a web request would carry."""
    report = F.struct(
        "title", F.col("report_type").alias("type"), "content", "metadata", rfc3339("generated_at").alias("generated_at")
    )
    return reports.withColumns(
        {
            "message": F.to_json(F.struct(message_text().alias("text"))),
            "request": F.to_json(F.struct(report.alias("report"))),
        }
    )


def report_file_name(template: str = "{title}_{timestamp}.txt") -> Column:
    """File name of a report from its title, type and time."""
    return tx.fill_placeholders(
        template,
        {
            "title": tx.sanitize_filename("title"), "type": F.col("report_type"),
            "timestamp": F.date_format("generated_at", "yyyyMMdd_HHmmss"),
            "date": F.date_format("generated_at", "yyyy-MM-dd"),
        },
    )


def report_subject(template: str) -> Column:
    return tx.fill_placeholders(
        template,
        {
            "title": F.col("title"), "type": F.col("report_type"),
            "generated_at": F.date_format("generated_at", "yyyy-MM-dd HH:mm:ss"),
        },
    )


# Generators: (kind of data, generator) -> function from keyword frames to a report frame.
GENERATORS: dict[tuple[str, str], Callable[..., DataFrame]] = {}


def register_generator(name: str, data: str, fn: Callable[..., DataFrame]) -> None:
    """Add a generator for one kind of data (run, task or period)."""
    GENERATORS[(name, data)] = fn


register_generator("summary", "run", lambda runs, tasks, **o: report_run_summary(runs, tasks, **o))
register_generator("detailed", "run", lambda runs, tasks, **o: report_run_detailed(runs, tasks, **o))
register_generator("summary", "task", lambda tasks, **o: report_task_summary(tasks, **o))
register_generator("detailed", "task", lambda tasks, **o: report_task_detailed(tasks, **o))
register_generator("summary", "period", lambda metrics, period, **o: report_period(metrics, period, **o))
register_generator("detailed", "period", lambda metrics, period, **o: report_period(metrics, period, kind="detailed", **o))
register_generator("metrics", "period", lambda metrics, period, template=None, **o: report_metrics_json(metrics, period, **o))


def generate_reports(generator: str, data: str, **frames) -> DataFrame:
    """Reports of one kind by one generator."""
    if data not in ("run", "task", "period"):
        raise ValueError(f"unknown kind of data {data!r}, expected run, task or period")
    if (generator, data) not in GENERATORS:
        names = sorted({n for n, _ in GENERATORS})
        raise ValueError(f"generator {generator!r} cannot report {data} data; generators: {names}")
    if data == "period" and frames.get("period") not in PERIOD_UNITS:
        raise ValueError(f"unknown period {frames.get('period')!r}")
    return GENERATORS[(generator, data)](**frames)
