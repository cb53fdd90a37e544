"""Task and run results: upsert, summary, status rollup, skip filling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.status import is_failed, is_finished, is_successful, success_rate
from .windows import top_n_per_key

# Reasons written to skipped tasks.
DEPENDENCIES_FAILED = "Dependencies failed"
CONDITION_NOT_MET = "Condition not met"


def latest_per_task(attempts: DataFrame, order: Sequence[str], keys: Sequence[str] = ("run_id", "task_id")) -> DataFrame:
    """Last result of every task wins; ``order`` must be total within a task.

    Each map task forwards one row per key only, so a task retried a billion times
    does not end up whole in one reducer.
    """
    return top_n_per_key(attempts, keys, [F.col(c).desc() for c in order], 1)


def summary_columns(status: str = "status") -> list[Column]:
    """Counters of the run summary: timeouts count as failed, cancelled on their own."""
    s = F.col(status)
    return [
        F.count("*").alias("total_tasks"),
        F.count_if(is_successful(s)).alias("successful_tasks"),
        F.count_if(s.isin("failed", "timeout")).alias("failed_tasks"),
        F.count_if(s == "skipped").alias("skipped_tasks"),
        F.count_if(s == "cancelled").alias("cancelled_tasks"),
    ]


def run_summary(tasks: DataFrame, key: str = "run_id") -> DataFrame:
    return tasks.groupBy(key).agg(*summary_columns()).withColumn(
        "success_rate", success_rate("successful_tasks", "total_tasks")
    )


def nested_summary(tasks: str = "tasks") -> list[Column]:
    """The same counters for a row that carries its tasks as an array."""
    statuses = F.transform(tasks, lambda t: t["status"])

    def count(*names: str) -> Column:
        return F.greatest(F.size(F.filter(statuses, lambda s: s.isin(*names))), F.lit(0)).cast("long")

    total = F.greatest(F.size(tasks), F.lit(0)).cast("long")
    return [
        total.alias("total_tasks"), count("success").alias("successful_tasks"),
        count("failed", "timeout").alias("failed_tasks"), count("skipped").alias("skipped_tasks"),
        count("cancelled").alias("cancelled_tasks"), success_rate(count("success"), total).alias("success_rate"),
    ]


def _rollup(running: Column, failed: Column, succeeded: Column) -> Column:
    return (
        F.when(running, "running")
        .when(failed & succeeded, "partial_success")
        .when(failed, "failed")
        .otherwise("success")
    )


def run_status(tasks: DataFrame, runs: DataFrame, key: str = "run_id") -> DataFrame:
    """Status of every run from its tasks; a run without tasks is a success."""
    flags = tasks.groupBy(key).agg(
        F.bool_or(F.col("status") == "running").alias("r"),
        F.bool_or(is_failed("status")).alias("f"),
        F.bool_or(is_successful("status")).alias("s"),
    )
    no = F.lit(False)
    return runs.select(key).join(flags, key, "left").select(
        key, _rollup(*[F.coalesce(F.col(c), no) for c in "rfs"]).alias("status")
    )


def run_facts(runs: DataFrame, tasks: DataFrame, key: str = "run_id") -> DataFrame:
    """One row per run: its own columns, the derived status and the summary counters.

    Summary and status come out of the same aggregation, so tasks are shuffled once.
    """
    counts = tasks.groupBy(key).agg(
        *summary_columns(),
        F.bool_or(F.col("status") == "running").alias("__r"),
        F.bool_or(is_failed("status")).alias("__f"),
        F.bool_or(is_successful("status")).alias("__s"),
    )
    counters = ["total_tasks", "successful_tasks", "failed_tasks", "skipped_tasks", "cancelled_tasks"]
    own = [c for c in runs.columns if c not in {"status", "tasks", "summary"}]
    joined = runs.select(*own).join(counts, key, "left")
    zero, no = F.lit(0).cast("long"), F.lit(False)
    return joined.select(
        *own,
        _rollup(*[F.coalesce(F.col(c), no) for c in ("__r", "__f", "__s")]).alias("status"),
        *[F.coalesce(F.col(c), zero).alias(c) for c in counters],
        success_rate(F.coalesce("successful_tasks", zero), F.coalesce("total_tasks", zero)).alias("success_rate"),
    )


def task_facts(runs: DataFrame, tasks: DataFrame, key: str = "run_id") -> DataFrame:
    """Tasks with the name and metadata of their run."""
    context = [c for c in ("workflow_name", "metadata") if c in runs.columns]
    renamed = runs.select(key, *[F.col(c).alias("run_metadata" if c == "metadata" else c) for c in context])
    return tasks.drop("workflow_name").join(renamed, key)


def explode_tasks(nested_runs: DataFrame) -> DataFrame:
    """Tasks of runs that carry them as an array, in their written order."""
    return nested_runs.select(
        "run_id", "workflow_name", F.posexplode("tasks").alias("ordinal", "task")
    ).select("run_id", "workflow_name", "ordinal", "task.*")


def state_counts(tasks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How many tasks are pending, running and finished."""
    return tasks.groupBy(*keys).agg(
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status") == "running").alias("running"),
        F.count_if(is_finished("status")).alias("completed"),
    )


def with_definition(tasks: DataFrame, definitions: DataFrame) -> DataFrame:
    """Attach the definition columns to every result of a defined task.

    No broadcast hint: Spark broadcasts the definitions when they are measured to be
    small and otherwise shuffles both sides, splitting hot workflows.
    """
    return tasks.join(definitions, ["workflow_name", "task_id"])


def fill_skipped(runs: DataFrame, tasks: DataFrame, definitions: DataFrame) -> DataFrame:
    """Results plus a skipped row for every defined task without a result."""
    expected = runs.select("run_id", "workflow_name").join(
        definitions.select("workflow_name", "task_id", "task_type"), "workflow_name"
    )
    missing = expected.join(tasks.select("run_id", "task_id"), ["run_id", "task_id"], "left_anti")
    columns = ["run_id", "workflow_name", "task_id", "task_type", "status", "error"]
    skipped = missing.withColumn("status", F.lit("skipped")).withColumn("error", F.lit(DEPENDENCIES_FAILED))
    return tasks.select(*columns).unionByName(skipped.select(*columns))


def dependencies_met(tasks: DataFrame, edges: DataFrame, key: str = "run_id") -> DataFrame:
    """Whether all dependencies of a task succeeded; a dependency without a result has not."""
    sources = tasks.select(key, F.col("task_id").alias("src"), is_successful("status").alias("__ok"))
    by_task = (
        edges.join(sources, [key, "src"], "left")
        .groupBy(key, F.col("dst").alias("task_id"))
        .agg(F.bool_and(F.coalesce(F.col("__ok"), F.lit(False))).alias("__met"))
    )
    return tasks.join(by_task, [key, "task_id"], "left").withColumn(
        "dependencies_met", F.coalesce(F.col("__met"), F.lit(True))
    ).drop("__met")


def apply_when(tasks: DataFrame, conditions: Mapping[str, str], by: str = "task_id") -> DataFrame:
    """Skip tasks whose condition does not hold.

    ``conditions`` maps a task to a SQL boolean expression over the row's columns; a
    condition that is false or unknown skips the task.
    """
    holds = F.lit(True)
    for task_id, condition in conditions.items():
        holds = F.when(F.col(by) == task_id, F.coalesce(F.expr(condition), F.lit(False))).otherwise(holds)
    out = tasks.withColumn("__holds", holds)
    error = F.col("error") if "error" in tasks.columns else F.lit(None).cast("string")
    return (
        out.withColumn("error", F.when(F.col("__holds"), error).otherwise(CONDITION_NOT_MET))
        .withColumn("status", F.when(F.col("__holds"), F.col("status")).otherwise("skipped"))
        .drop("__holds")
    )


def condition_holds(condition: Column, columns: Sequence[str]) -> Column:
    """Whether a condition, a struct of texts (field, comparison, value), holds for the row; null where it can't be told.

    ``columns`` are those that conditions may name. Numbers are compared as numbers, anything else as text. An unknown
    field or comparison can't be told, as can't a null on either side.
    """
    value = F.try_element_at(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]), condition["field"])
    number, limit = value.try_cast("double"), condition["value"].try_cast("double")
    both = number.isNotNull() & limit.isNotNull()
    order = F.when(both, F.signum(number - limit).cast("int")).otherwise(
        F.when(value < condition["value"], -1).when(value > condition["value"], 1).when(value == condition["value"], 0))
    tests = {"=": order == 0, "!=": order != 0, "<": order < 0, "<=": order <= 0, ">": order > 0, ">=": order >= 0}
    holds = F.lit(None).cast("boolean")
    for comparison, test in tests.items():
        holds = F.when(condition["comparison"] == comparison, test).otherwise(holds)
    return holds


def apply_conditions(tasks: DataFrame, definitions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Skip results whose definition has a condition that does not hold for them.

    ``definitions`` has one row a task (workflow_name, task_id, when), ``when`` as in ``condition_holds`` or null for
    none. Like ``apply_when``, with conditions that are data: each workflow has its own, and any number of them.
    """
    conditions = definitions.filter(F.col("when").isNotNull()).select("workflow_name", "task_id", F.col("when").alias("__when"))
    known = tasks.join(conditions, ["workflow_name", "task_id"], "left")
    skip = F.col("__when").isNotNull() & ~F.coalesce(condition_holds(F.col("__when"), columns), F.lit(False))
    error = F.col("error") if "error" in tasks.columns else F.lit(None).cast("string")
    marked = known.withColumn("__skip", skip)
    others = [F.col(c) for c in tasks.columns if c not in ("status", "error")]
    return marked.select(
        *others, F.when(F.col("__skip"), "skipped").otherwise(F.col("status")).alias("status"),
        F.when(F.col("__skip"), CONDITION_NOT_MET).otherwise(error).alias("error"))


def critical_tasks(tasks: DataFrame, definitions: DataFrame, continue_on_error: bool | None = None) -> DataFrame:
    """Failures that stop their run.

    A failed required task always does. Where ``continue_on_error`` is false every failure is
    critical; null (no error handling configured) and true leave it at required ones. It is a
    column of ``definitions``, a value for each workflow; the argument overrides it for all.
    """
    failed = tasks.filter(is_failed("status"))
    if continue_on_error is False:
        return failed
    required = definitions.filter(F.coalesce(F.col("required"), F.lit(True))).select("workflow_name", "task_id")
    if continue_on_error is None and "continue_on_error" in definitions.columns:
        strict = definitions.filter(~F.col("continue_on_error")).select("workflow_name").distinct().withColumn("__strict", F.lit(True))
        needed = required.distinct().withColumn("__required", F.lit(True))
        known = failed.join(strict, "workflow_name", "left").join(needed, ["workflow_name", "task_id"], "left")
        return known.filter("__strict or __required").select(*failed.columns)
    return failed.join(required, ["workflow_name", "task_id"], "left_semi")


def critical_runs(tasks: DataFrame, definitions: DataFrame, continue_on_error: bool | None = None) -> DataFrame:
    """Per run: does it have to stop, and because of how many tasks."""
    critical = critical_tasks(tasks, definitions, continue_on_error).groupBy("run_id").agg(
        F.count("*").alias("critical_tasks")
    )
    return tasks.groupBy("run_id").agg(F.count_if(is_failed("status")).alias("failed_or_cancelled")).join(
        critical, "run_id", "left"
    ).select(
        "run_id",
        "failed_or_cancelled",
        F.coalesce("critical_tasks", F.lit(0).cast("long")).alias("critical_tasks"),
        F.col("critical_tasks").isNotNull().alias("must_stop"),
    )
