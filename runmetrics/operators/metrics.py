"""Metrics over run and task facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.status import is_failed, success_rate, utilization
from ..functions.times import next_period, period_start
from .windows import running_sums, top_n_per_key

RETENTION_LIMIT = 10_000  # fixed value: records kept by default
RETENTION_DAYS = 30  # fixed value: days kept by default


def in_period(df: DataFrame, start: Column, end: Column, on: str = "start_time") -> DataFrame:
    """Rows with ``start <= on < end``; a plain comparison, so it reaches the file scan."""
    return df.filter((F.col(on) >= start) & (F.col(on) < end))


def retain_days(df: DataFrame, days: int = RETENTION_DAYS, as_of: Column | None = None, on: str = "start_time") -> DataFrame:
    now = F.current_timestamp() if as_of is None else as_of
    return df.filter(F.col(on) >= now - F.expr(f"interval {int(days)} day"))


def _facts(runs: DataFrame, tasks: DataFrame, *extra: Column) -> DataFrame:
    """Runs and tasks as one tall frame, so that both are counted by one aggregation."""

    def pick(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), "status", "duration_ms", *extra)

    return pick(runs, "run").unionByName(pick(tasks, "task"))


def _execution_columns(partial_is_success: bool) -> list[Column]:
    kind, status = F.col("kind"), F.col("status")

    def count(what: str, *statuses: str) -> Column:
        return F.count_if((kind == what) & status.isin(*statuses))

    good = ("success", "partial_success") if partial_is_success else ("success",)
    return [
        F.count_if(kind == "run").alias("total_workflows"),
        count("run", *good).alias("successful_workflows"),
        count("run", "failed").alias("failed_workflows"),
        F.count_if(kind == "task").alias("total_tasks"),
        count("task", "success").alias("successful_tasks"),
        count("task", "failed").alias("failed_tasks"),
        count("task", "skipped").alias("skipped_tasks"),
        count("task", "cancelled").alias("cancelled_tasks"),
        count("task", "timeout").alias("timeout_tasks"),
        F.avg(F.when(kind == "run", F.col("duration_ms"))).alias("avg_workflow_duration_ms"),
        F.avg(F.when(kind == "task", F.col("duration_ms"))).alias("avg_task_duration_ms"),
    ]


def _with_rates(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "workflow_success_rate", success_rate("successful_workflows", "total_workflows")
    ).withColumn("task_success_rate", success_rate("successful_tasks", "total_tasks"))


def execution_metrics(
    runs: DataFrame, tasks: DataFrame, start: Column, end: Column, partial_is_success: bool = False
) -> DataFrame:
    """One row of counters, averages and rates for the runs and tasks started in a period."""
    facts = _facts(in_period(runs, start, end), in_period(tasks, start, end))
    return _with_rates(facts.agg(*_execution_columns(partial_is_success))).select(
        "*", start.alias("period_start"), end.alias("period_end")
    )


def period_series(runs: DataFrame, tasks: DataFrame, period: str, partial_is_success: bool = False) -> DataFrame:
    """The same metrics for every period that has data, one row each."""
    facts = _facts(runs, tasks, period_start("start_time", period).alias("period_start"))
    return _with_rates(facts.groupBy("period_start").agg(*_execution_columns(partial_is_success)))


def running_totals(runs: DataFrame, tasks: DataFrame, partial_is_success: bool = True) -> DataFrame:
    """Counters over everything recorded so far; a partial success counts as one."""
    totals = _facts(runs, tasks).agg(*_execution_columns(partial_is_success))
    return _with_rates(totals).drop("timeout_tasks", "avg_workflow_duration_ms", "avg_task_duration_ms")


def performance_by_workflow(runs: DataFrame) -> DataFrame:
    status = F.col("status")
    return runs.groupBy("workflow_name").agg(
        F.count("*").alias("total_runs"),
        F.count_if(status == "success").alias("successful_runs"),
        F.count_if(status == "failed").alias("failed_runs"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.min("duration_ms").alias("min_duration_ms"),
        F.max("duration_ms").alias("max_duration_ms"),
    ).withColumn("success_rate", success_rate("successful_runs", "total_runs"))


def performance_by_task_type(tasks: DataFrame) -> DataFrame:
    status = F.col("status")
    return tasks.groupBy("task_type").agg(
        F.count("*").alias("total_executions"),
        F.count_if(status == "success").alias("successful_executions"),
        F.count_if(status == "failed").alias("failed_executions"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.avg("retry_count").alias("avg_retry_count"),
    ).withColumn("success_rate", success_rate("successful_executions", "total_executions"))


def hourly_metrics(runs: DataFrame) -> DataFrame:
    """Per start hour: runs started and completed, their tasks, their average duration."""
    return runs.groupBy(period_start("start_time", "hourly").alias("hour")).agg(
        F.count("*").alias("workflows_started"),
        F.count("end_time").alias("workflows_completed"),
        F.sum("total_tasks").alias("tasks_executed"),
        F.avg("duration_ms").alias("avg_workflow_duration_ms"),
    )


def workflow_overview(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.col("workflow_name").alias("name")).agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("status") == "success").alias("__ok"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.sum("total_tasks").alias("total_tasks"),
        F.max("start_time").alias("last_run"),
    ).withColumn("success_rate", success_rate("__ok", "runs")).drop("__ok")


def top_workflows(runs: DataFrame, k: int = 10) -> DataFrame:
    """The k workflows with the most runs; ties go by name."""
    return workflow_overview(runs).orderBy(F.desc("runs"), "name").limit(k)


def error_type(error: Column | str) -> Column:
    """The part of a message before its first colon."""
    text = F.col(error) if isinstance(error, str) else error
    return F.trim(F.substring_index(text, ":", 1))


def failure_patterns(tasks: DataFrame, k: int | None = None) -> DataFrame:
    """Kinds of failure with their share of all failures and when they were seen."""
    kinds = (
        tasks.filter(is_failed("status"))
        .groupBy(error_type(F.coalesce("error", F.lit("Unknown error"))).alias("error_type"))
        .agg(
            F.count("*").alias("count"),
            F.min("start_time").alias("first_seen"),
            F.max("start_time").alias("last_seen"),
        )
    )
    total = kinds.agg(F.sum("count")).scalar()
    shares = kinds.withColumn("percentage", F.col("count").cast("double") / total * F.lit(100.0))
    return shares if k is None else shares.orderBy(F.desc("count"), "error_type").limit(k)


def breakdown(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """By workflow, by task type and by hour in one tall table (section, key, measures).

    The two views of the runs are grouping sets of one aggregation. For hours,
    ``successful`` counts the completed runs.
    """
    none, by_name = F.lit(None), F.grouping("workflow_name") == 0
    keyed = runs.withColumn("hour", period_start("start_time", "hourly"))
    grouped = keyed.groupingSets([["workflow_name"], ["hour"]], "workflow_name", "hour").agg(
        by_name.alias("by_name"),
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "success").alias("ok"),
        F.count_if(F.col("status") == "failed").alias("bad"),
        F.count("end_time").alias("completed"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.sum("total_tasks").alias("tasks"),
    )
    of_runs = grouped.select(
        F.when(F.col("by_name"), "workflow").otherwise("hour").alias("section"),
        F.when(F.col("by_name"), F.col("workflow_name")).otherwise(F.date_format("hour", "yyyy-MM-dd HH:mm:ss")).alias("key"),
        "total", F.when(F.col("by_name"), F.col("ok")).otherwise(F.col("completed")).alias("successful"),
        F.when(F.col("by_name"), F.col("bad")).alias("failed"), "avg_duration_ms",
        F.when(F.col("by_name"), success_rate("ok", "total")).alias("success_rate"),
        none.cast("double").alias("avg_retry_count"), F.when(~F.col("by_name"), F.col("tasks")).alias("tasks_executed"),
    )
    by_type = performance_by_task_type(tasks).select(
        F.lit("task_type").alias("section"), F.col("task_type").alias("key"),
        F.col("total_executions").alias("total"), F.col("successful_executions").alias("successful"),
        F.col("failed_executions").alias("failed"), "avg_duration_ms", "success_rate", "avg_retry_count",
        none.cast("long").alias("tasks_executed"),
    )
    return of_runs.unionByName(by_type)


def history(
    df: DataFrame, workflow: str | None = None, task_type: str | None = None, limit: int | None = None,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Facts of one workflow or task type, newest first; ``tie`` orders equal times."""
    if workflow is not None:
        df = df.filter(F.col("workflow_name") == workflow)
    if task_type is not None:
        df = df.filter(F.col("task_type") == task_type)
    ordered = df.orderBy(F.desc("start_time"), *tie)
    return ordered if limit is None else ordered.limit(limit)


def retain_last(
    df: DataFrame, n: int = RETENTION_LIMIT, by: Sequence[str] = (), order: Sequence[str] = ("start_time",)
) -> DataFrame:
    """The newest n facts overall, or of every key."""
    newest = [F.col(c).desc() for c in order]
    return top_n_per_key(df, by, newest, n) if by else df.orderBy(*newest).limit(n)


# Names of the trend directions.
IMPROVING, STABLE, DEGRADING, UNKNOWN = "improving", "stable", "degrading", "unknown"


def trend(current: Column, previous: Column, tolerance: float, lower_is_better: bool) -> Column:
    change = (current - previous) / previous
    better, worse = (change < -tolerance, change > tolerance) if lower_is_better else (change > tolerance, change < -tolerance)
    return (
        F.when(current.isNull() | previous.isNull(), UNKNOWN)
        .when((previous == 0) & (current == 0), STABLE)
        .when(previous == 0, DEGRADING if lower_is_better else IMPROVING)
        .when(better, IMPROVING)
        .when(worse, DEGRADING)
        .otherwise(STABLE)
    )


def trends(series: DataFrame, period: str, keys: Sequence[str] = (), tolerance: float = 0.05) -> DataFrame:
    """Direction of durations, success rate and throughput against the period before.

    The period before is found by an equi-join on its start, not by a window, so a
    series without keys is not gathered in one task.
    """
    measures = {
        "workflow_duration_trend": ("avg_workflow_duration_ms", True),
        "task_duration_trend": ("avg_task_duration_ms", True),
        "success_rate_trend": ("workflow_success_rate", False),
        "throughput_trend": ("total_workflows", False),
    }
    names = [m for m, _ in measures.values()]
    before = series.select(
        *keys, next_period(F.col("period_start"), period).alias("period_start"),
        *[F.col(m).alias(f"previous_{m}") for m in names],
    )
    joined = series.join(before, [*keys, "period_start"], "left")
    return joined.select(
        *keys, "period_start", *names,
        *[
            trend(F.col(m), F.col(f"previous_{m}"), tolerance, lower).alias(name)
            for name, (m, lower) in measures.items()
        ],
    )


def concurrency_points(tasks: DataFrame, keys: Sequence[str], block: str = "day") -> DataFrame:
    """Tasks running right after every moment something started or ended.

    Starts and ends at the same moment are netted first, which is the same as letting
    the ends come first; a task without an end runs on.
    """
    keys = list(keys)
    events = tasks.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("start_time").alias("at"), F.lit(1).alias("delta")),
                F.struct(F.col("end_time").alias("at"), F.lit(-1).alias("delta")),
            )
        ).alias("e"),
    ).select(*keys, "e.at", "e.delta").filter(F.col("at").isNotNull())
    points = events.groupBy(*keys, "at").agg(F.sum("delta").alias("delta"))
    return running_sums(points, keys, "at", {"running": "delta"}, F.date_trunc(block, F.col("at")))


def concurrency_profile(tasks: DataFrame, capacity: int, keys: Sequence[str] = ("workflow_name",)) -> DataFrame:
    """Peak and current number of running tasks and the peak's share of the capacity."""
    return concurrency_points(tasks, keys).groupBy(*keys).agg(
        F.max("running").alias("peak_running"),
        F.sum("delta").alias("current_running"),
    ).withColumn("peak_utilization", utilization(F.col("peak_running"), F.lit(capacity)))
