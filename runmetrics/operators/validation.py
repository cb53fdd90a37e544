"""Checks over workflow definitions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import brace_error, destination_parts
from ..session import stored
from . import dag, small_graphs
from .windows import join_null_safe, running_sums

# Task types that can be run, and the texts of the findings.
TASK_TYPES = ("command", "compress", "checksum", "archive", "file", "s3", "email", "slack", "template")
MISSING_NAME = "Missing required field: name"
EMPTY_WORKFLOW = "Empty workflow: no tasks defined"
DUPLICATE_NAME = "Duplicate task name: %s"
UNKNOWN_DEPENDENCY = "Task '%s' depends on unknown task '%s'"
CYCLE = "Circular dependency detected in tasks: [\"%s\"]"
SELF_DEPENDENCY = "Task '%s' depends on itself"
NO_ROOT = "No root tasks found - all tasks have dependencies"
UNREACHABLE = "Task '%s' is unreachable"
INVALID_CONFIG = "Invalid task configuration for '%s': %s"
NULL_CONFIG = "task config cannot be null"
NO_ATTEMPTS = "max_attempts must be greater than 0"
NO_BACKOFF = "backoff_multiplier must be greater than 0"
UNSUPPORTED_TYPE = "Unsupported task type '%s' in task '%s'. Supported types: [%s]"
INVALID_TEMPLATE = "Invalid template syntax in 'tasks.%s.when': %s"
INVALID_OUTPUT = "Invalid output configuration: "
EMPTY_DESTINATION = "destination cannot be empty"
NOT_A_URL = "Invalid output destination URL"
NO_BUCKET = "S3 URL must include bucket name as host"
UNSUPPORTED_SCHEME = "Unsupported output scheme: "

ERROR, WARNING = "error", "warning"
ISSUE_COLUMNS = ("workflow", "task", "ordinal", "severity", "kind", "message")


def _issue(df: DataFrame, severity: str, kind: str, message: Column, task: bool = True) -> DataFrame:
    return df.select(
        "workflow",
        (F.col("task") if task else F.lit(None).cast("string")).alias("task"),
        (F.col("ordinal") if task else F.lit(-1)).cast("int").alias("ordinal"),
        F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), message.alias("message"),
    )


def config_issues(definitions: DataFrame, task_types: Sequence[str] | None = TASK_TYPES) -> DataFrame:
    """Checks that need one row only, all in one pass: the first failing one is reported."""
    reason = (
        F.when(F.col("config").isNull(), NULL_CONFIG)
        .when(F.col("max_attempts") == 0, NO_ATTEMPTS)
        .when(F.col("backoff_multiplier") <= 0, NO_BACKOFF)
    )
    text = F.format_string(INVALID_CONFIG, F.col("task"), reason)
    kind = F.when(reason.isNotNull(), "config")
    if task_types is not None:
        unsupported = F.col("config").isNotNull() & ~F.col("task_type").isin(*task_types)
        text = F.when(
            unsupported, F.format_string(UNSUPPORTED_TYPE, F.col("task_type"), F.col("task"), F.lit(", ".join(f'"{t}"' for t in task_types)))
        ).otherwise(text)
        kind = F.when(unsupported, "task_type").otherwise(kind)
    problem = brace_error("when")
    issues = F.array_compact(
        F.array(
            F.when(kind.isNotNull(), F.struct(kind.alias("kind"), text.alias("message"))),
            F.when(
                problem.isNotNull(),
                F.struct(
                    F.lit("template").alias("kind"),
                    F.format_string(INVALID_TEMPLATE, F.col("task"), problem).alias("message"),
                ),
            ),
        )
    )
    exploded = definitions.select("workflow", "task", "ordinal", F.explode(issues).alias("i"))
    return exploded.select(
        "workflow", "task", F.col("ordinal").cast("int").alias("ordinal"), F.lit(ERROR).alias("severity"), "i.kind", "i.message"
    )


def duplicate_names(definitions: DataFrame) -> DataFrame:
    """Display names used by more than one task of a workflow; unnamed tasks go by their id."""
    shown = definitions.select("workflow", F.coalesce("name", "task").alias("name"), F.col("ordinal").cast("int").alias("ordinal"))
    return shown.groupBy("workflow", "name").agg(F.count("*").alias("uses"), F.min("ordinal").alias("ordinal")).filter("uses > 1")


def workflow_issues(workflows: DataFrame, definitions: DataFrame) -> DataFrame:
    """Checks on the workflow row: name, destination, and that there are tasks at all."""
    name, url = F.trim("workflow_name"), F.col("output_destination")
    scheme, host = destination_parts(url)
    bad_output = (
        F.when(F.trim(F.coalesce(url, F.lit(""))) == "", EMPTY_DESTINATION)
        .when(scheme == "", NOT_A_URL)
        .when((scheme == "s3") & (host == ""), NO_BUCKET)
        .when(~scheme.isin("file", "s3"), F.concat(F.lit(UNSUPPORTED_SCHEME), scheme))
    )
    found = F.array_compact(
        F.array(
            F.when(
                F.coalesce(name, F.lit("")) == "",
                F.struct(F.lit("name").alias("kind"), F.lit(MISSING_NAME).alias("message")),
            ),
            F.when(
                bad_output.isNotNull(),
                F.struct(
                    F.lit("output").alias("kind"),
                    F.concat(F.lit(INVALID_OUTPUT), bad_output).alias("message"),
                ),
            ),
        )
    )
    rows = workflows.select("workflow", F.explode(found).alias("i")).select("workflow", "i.kind", "i.message")
    on_row = rows.select(
        "workflow", F.lit(None).cast("string").alias("task"), F.lit(-1).alias("ordinal"),
        F.lit(ERROR).alias("severity"), "kind", "message",
    )
    empty = workflows.join(definitions.select("workflow"), "workflow", "left_anti")
    return on_row.unionByName(_issue(empty, ERROR, "empty", F.lit(EMPTY_WORKFLOW), task=False))


def definition_issues(
    workflows: DataFrame, definitions: DataFrame, task_types: Sequence[str] | None = TASK_TYPES
) -> DataFrame:
    """Every problem of every workflow, one row each.

    ``workflows`` has (workflow, workflow_name, output_destination); ``definitions`` has
    (workflow, task, ordinal, name, task_type, depends_on, max_attempts,
    backoff_multiplier, when, config).
    """
    # The graph checks read both many times over, so they are computed once.
    places = stored(definitions.select("workflow", "task", F.col("ordinal").cast("int").alias("ordinal")), "places")
    edges = stored(dag.dag_edges(definitions), "edges")
    nodes = places.select("workflow", "task")
    graphs = small_graphs.Graphs("workflow", nodes, edges)
    task = F.col("task")

    def graph_issue(df: DataFrame, severity: str, kind: str, message: Column) -> DataFrame:
        return df.select("workflow", "task", F.lit(severity).alias("severity"), F.lit(kind).alias("kind"),
                         message.alias("message"))

    on_graph = [
        graph_issue(dag.unknown_dependencies(nodes, edges, graphs=graphs), ERROR, "unknown_dependency",
                    F.format_string(UNKNOWN_DEPENDENCY, task, F.col("dependency"))),
        graph_issue(dag.dag_cycles(nodes, edges, graphs=graphs), ERROR, "cycle",
                    F.format_string(CYCLE, task)),
        graph_issue(dag.self_dependencies(edges), ERROR, "self_dependency",
                    F.format_string(SELF_DEPENDENCY, task)),
        graph_issue(dag.dag_unreachable(nodes, edges, graphs=graphs), WARNING, "unreachable",
                    F.format_string(UNREACHABLE, task)),
    ]
    placed = reduce(DataFrame.unionByName, on_graph).join(places, ["workflow", "task"])
    parts = [
        placed.select(*ISSUE_COLUMNS),
        config_issues(definitions, task_types),
        workflow_issues(workflows, definitions),
        _issue(duplicate_names(definitions).withColumn("task", F.lit(None).cast("string")), ERROR, "duplicate",
               F.format_string(DUPLICATE_NAME, F.col("name"))),
        _issue(dag.workflows_without_root(nodes, edges, graphs=graphs), WARNING, "no_root",
               F.lit(NO_ROOT), task=False),
    ]
    return reduce(DataFrame.unionByName, parts)


def validate_definitions(workflows: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per workflow: counts and the verdict."""
    counts = issues.groupBy("workflow").agg(
        F.count_if(F.col("severity") == ERROR).alias("errors"),
        F.count_if(F.col("severity") == WARNING).alias("warnings"),
    )
    zero = F.lit(0).cast("long")
    return workflows.select("workflow").join(counts, "workflow", "left").select(
        "workflow",
        F.coalesce("errors", zero).alias("errors"),
        F.coalesce("warnings", zero).alias("warnings"),
        (F.coalesce("errors", zero) == 0).alias("is_valid"),
    )


def validation_messages(issues: DataFrame, per_page: int = 1000) -> DataFrame:
    """The messages as arrays, a page of ``per_page`` messages per row.

    A workflow of any size is listed whole, but no row holds more than one page of it, also
    when one task has most of its messages; ordinary workflows have a single page, and only the others are numbered.
    """
    # counted, then grouped: the checks behind the issues run once
    issues = stored(issues.select("workflow", "ordinal", "severity", "kind", "message"), "issues")
    ordinal = F.coalesce("ordinal", F.lit(-1))
    issues = issues.withColumn("ordinal", ordinal)
    several = stored(issues.groupBy("workflow").agg(F.count("*").alias("__n")).filter(F.col("__n") > per_page).select("workflow"), "several-pages")
    if several.isEmpty():
        return _paged(issues, F.lit(0).cast("long").alias("page"))
    # there is at most one such workflow for every per_page rows
    named = F.broadcast(several)
    single = join_null_safe(issues, named, ["workflow"], "left_anti")
    return _paged(single, F.lit(0).cast("long").alias("page")).unionByName(_numbered(join_null_safe(issues, named, ["workflow"], "left_semi"), per_page))


def _numbered(issues: DataFrame, per_page: int) -> DataFrame:
    ordinal = F.col("ordinal")
    counts = issues.groupBy("workflow", ordinal.alias("ordinal")).agg(F.count("*").alias("__n"))
    sums = running_sums(counts, ["workflow"], "ordinal", {"__upto": "__n"}, F.floor(F.col("ordinal") / 1000))
    # A task's messages are spread by their text and numbered within each part, so that no task sorts all of them.
    spread = issues.withColumns({"ordinal": ordinal, "__part": F.pmod(F.xxhash64("message"), F.lit(64))})
    parts = spread.groupBy("workflow", "ordinal", "__part").agg(F.count("*").alias("__p"))
    part_sums = running_sums(parts, ["workflow", "ordinal"], "__part", {"__parts": "__p"}, F.col("__part"))
    within = Window.partitionBy("workflow", "ordinal", "__part").orderBy("kind", "message")
    numbered = join_null_safe(spread.withColumn("__at", F.row_number().over(within)), part_sums, ["workflow", "ordinal", "__part"])
    placed = join_null_safe(numbered, sums, ["workflow", "ordinal"])
    issues = placed.withColumn("__place", F.col("__upto") - F.col("__n") + F.col("__parts") - F.col("__p") + F.col("__at") - 1)
    return _paged(issues, F.floor(F.col("__place") / per_page).alias("page"))


def _paged(issues: DataFrame, page: Column) -> DataFrame:
    def messages(severity: str) -> Column:
        picked = F.collect_list(F.when(F.col("severity") == severity, F.struct("ordinal", "kind", "message")))
        return F.transform(F.array_sort(picked), lambda x: x["message"])

    return issues.groupBy("workflow", page).agg(
        messages(ERROR).alias("errors"), messages(WARNING).alias("warnings")
    )
