"""Running totals that read new data only.

A load of finished runs and their task results is summed up once, by kind (run or task), start hour and name (workflow or
task type), and stored. Counters, sums, minima and maxima of these rows can be merged, so totals, period metrics and
breakdowns come from the stored rows alone: a load costs what it brings, and a report costs hours times names. A load has
a name and is taken in once, however often it is sent. Loads are versions of a snapshot log; after ``FOLD`` of them the
stored rows are merged into one table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.status import success_rate
from ..functions.times import period_start
from ..sources.snapshots import SnapshotLog

FOLD = 16
STATUSES = ("success", "partial_success", "failed", "skipped", "cancelled", "timeout")
KEYS = ("kind", "hour", "name")
_ADDED = ("n", *STATUSES, "completed", "tasks", "ms_sum", "ms_n", "retry_sum", "retry_n")
SCHEMA = "kind string, hour timestamp, name string, " + ", ".join(f"{c} long" for c in (*_ADDED, "ms_min", "ms_max"))


def _merge() -> list[Column]:
    return [*[F.sum(c).alias(c) for c in _ADDED], F.min("ms_min").alias("ms_min"), F.max("ms_max").alias("ms_max")]


def partials(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row for each kind, start hour and name; runs and tasks go through one aggregation."""
    def rows(df: DataFrame, kind: str, name: str, **own: Column) -> DataFrame:
        none = F.lit(None).cast("long")
        return df.select(
            F.lit(kind).alias("kind"), period_start("start_time", "hourly").alias("hour"), F.col(name).alias("name") if name in df.columns else F.lit(None).cast("string").alias("name"),
            "status", "duration_ms", "end_time", *[own.get(c, none).cast("long").alias(c) for c in ("total_tasks", "retry_count")])

    tall = rows(runs, "run", "workflow_name", total_tasks=F.col("total_tasks")).unionByName(rows(tasks, "task", "task_type", retry_count=F.col("retry_count")))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return tall.groupBy(*KEYS).agg(
        F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count("end_time").alias("completed"),
        zero(F.sum("total_tasks")).alias("tasks"), zero(F.sum("duration_ms")).alias("ms_sum"), F.count("duration_ms").alias("ms_n"),
        zero(F.sum("retry_count")).alias("retry_sum"), F.count("retry_count").alias("retry_n"),
        F.min("duration_ms").cast("long").alias("ms_min"), F.max("duration_ms").cast("long").alias("ms_max"))


class StoredTotals:
    def __init__(self, spark: SparkSession, path: str, fold: int = FOLD):
        self.spark, self.log, self.fold = spark, SnapshotLog(spark, path), fold
        self.schema = T.StructType.fromDDL(SCHEMA)

    def add(self, load: str, runs: DataFrame, tasks: DataFrame) -> bool:
        """Take in a load; False if one of that name is in already."""
        if load in self.log.latest()[1].get("loads", ()):
            return False
        part = self._write(partials(runs, tasks))
        added = []

        def change(state: dict) -> dict | None:
            added.append(load not in state.get("loads", ()))
            if not added[-1]:
                return None
            parts = [*state.get("parts", ()), part]
            if len(parts) > self.fold:
                parts = [self._write(self._read(parts).groupBy(*KEYS).agg(*_merge()))]
            return {"loads": [*state.get("loads", ()), load], "parts": parts}

        self.log.update(change)
        return added[-1]

    def _write(self, df: DataFrame) -> str:
        path = self.log.new_folder()
        df.write.parquet(path)
        return path

    def _read(self, parts: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        """The stored rows; a kind, hour and name may have several, to be merged."""
        return self._read(self.log.latest()[1].get("parts", ()))

    def forget(self, keep: int = 2) -> list[str]:
        return self.log.forget(lambda state: list(state.get("parts", ())), keep)


def _average(total: str, n: str) -> Column:
    return F.when(F.col(n) > 0, F.col(total) / F.col(n))


def _sum(c: str | Column, kind: str | None = None) -> Column:
    value = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(value if kind is None else F.when(F.col("kind") == kind, value)), F.lit(0).cast("long"))


def _counters(partial_is_success: bool) -> list[Column]:
    good = F.col("success") + F.col("partial_success") if partial_is_success else F.col("success")
    return [
        _sum("n", "run").alias("total_workflows"), _sum(good, "run").alias("successful_workflows"), _sum("failed", "run").alias("failed_workflows"),
        _sum("n", "task").alias("total_tasks"), _sum("success", "task").alias("successful_tasks"), _sum("failed", "task").alias("failed_tasks"),
        _sum("skipped", "task").alias("skipped_tasks"), _sum("cancelled", "task").alias("cancelled_tasks"), _sum("timeout", "task").alias("timeout_tasks"),
        *[_sum(c, kind).alias(f"__{kind}_{c}") for kind in ("run", "task") for c in ("ms_sum", "ms_n")],
    ]


def _rated(df: DataFrame) -> DataFrame:
    averages = {"avg_workflow_duration_ms": _average("__run_ms_sum", "__run_ms_n"), "avg_task_duration_ms": _average("__task_ms_sum", "__task_ms_n")}
    rates = {"workflow_success_rate": success_rate("successful_workflows", "total_workflows"), "task_success_rate": success_rate("successful_tasks", "total_tasks")}
    return df.withColumns({**averages, **rates}).drop(*[c for c in df.columns if c.startswith("__")])


def running_totals(rows: DataFrame, partial_is_success: bool = True) -> DataFrame:
    """As ``metrics.running_totals``, from stored rows."""
    return _rated(rows.agg(*_counters(partial_is_success))).drop("timeout_tasks", "avg_workflow_duration_ms", "avg_task_duration_ms")


def execution_metrics(rows: DataFrame, start: Column, end: Column, partial_is_success: bool = False) -> DataFrame:
    """As ``metrics.execution_metrics``, for periods of whole hours."""
    inside = rows.filter((F.col("hour") >= start) & (F.col("hour") < end))
    return _rated(inside.agg(*_counters(partial_is_success))).select("*", start.alias("period_start"), end.alias("period_end"))


def period_series(rows: DataFrame, period: str, partial_is_success: bool = False) -> DataFrame:
    """As ``metrics.period_series``."""
    return _rated(rows.groupBy(period_start("hour", period).alias("period_start")).agg(*_counters(partial_is_success)))


def breakdown(rows: DataFrame) -> DataFrame:
    """As ``metrics.breakdown``: by workflow, by task type and by hour, from one aggregation of the stored rows."""
    run, by_name = F.col("kind") == "run", F.grouping("name") == 0
    sets = rows.groupingSets([["kind", "name"], ["kind", "hour"]], "kind", "name", "hour").agg(by_name.alias("by_name"), *[_sum(c).alias(c) for c in _ADDED])
    none = F.lit(None)
    ok = F.when(F.col("by_name"), F.col("success")).otherwise(F.col("completed"))
    section = F.when(~F.col("by_name"), "hour").when(run, "workflow").otherwise("task_type")
    return sets.filter(F.col("by_name") | run).select(
        section.alias("section"), F.when(F.col("by_name"), F.col("name")).otherwise(F.date_format("hour", "yyyy-MM-dd HH:mm:ss")).alias("key"),
        F.col("n").alias("total"), ok.alias("successful"), F.when(F.col("by_name"), F.col("failed")).alias("failed"),
        _average("ms_sum", "ms_n").alias("avg_duration_ms"), F.when(F.col("by_name"), success_rate("success", "n")).alias("success_rate"),
        F.when(~run, _average("retry_sum", "retry_n")).otherwise(none.cast("double")).alias("avg_retry_count"),
        F.when(~F.col("by_name"), F.col("tasks")).alias("tasks_executed"))
