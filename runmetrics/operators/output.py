"""Formatted output of nested runs: which fields and which tasks are written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import LISTING_MARKER, truncate_text
from ..functions.times import rfc3339
from .results import nested_summary
from .routing import outcome_filter


@dataclass(frozen=True)
class OutputOptions:
    include_metadata: bool = False
    include_timestamps: bool = False
    include_duration: bool = False
    include_task_results: bool = True
    filter_successful: bool = False
    filter_failed: bool = False
    max_output_length: int | None = None
    include_system_info: bool = False


def _common(get, options: OutputOptions) -> list[Column]:
    fields = []
    if options.include_timestamps:
        fields += [rfc3339(get("start_time")).alias("start_time"), rfc3339(get("end_time")).alias("end_time")]
    if options.include_duration:
        fields.append((get("duration_ms") / F.lit(1000.0)).alias("duration_seconds"))
    return fields


def _metadata(c: Column) -> Column:
    return F.when(F.size(c) > 0, c).alias("metadata")


def task_fields(get, options: OutputOptions) -> list[Column]:
    """Output fields of one task; ``get`` returns the column of a task field. Null ones are left out of JSON."""
    output = get("output")
    if options.max_output_length is not None:
        output = truncate_text(output, options.max_output_length, LISTING_MARKER)
    fields = [
        get("task_id").alias("task_id"), get("task_type").alias("task_type"), get("status").alias("status"),
        *_common(get, options),
        output.alias("output"), get("error").alias("error"),
        F.when(get("retry_count") > 0, get("retry_count")).alias("retry_count"),
    ]
    if options.include_metadata:
        fields.append(_metadata(get("metadata")))
    return fields


def project_tasks(tasks: DataFrame, options: OutputOptions, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """The output fields of the selected tasks, one row per task."""
    none = {"end_time": "timestamp", "output": "string", "error": "string", "metadata": "map<string,string>"}

    def get(name: str) -> Column:
        return F.col(name) if name in tasks.columns else F.lit(None).cast(none.get(name, "string"))

    kept = tasks.filter(outcome_filter("status", options.filter_successful, options.filter_failed))
    return kept.select(*keys, *task_fields(get, options))


def project_runs(nested: DataFrame, options: OutputOptions) -> DataFrame:
    """The output fields of runs that carry their tasks; nothing is exploded or shuffled."""
    summary = F.struct(*nested_summary("tasks"))
    fields = [F.col("workflow_name"), F.col("run_id"), F.col("status"), *_common(F.col, options), summary.alias("summary")]
    if options.include_task_results:
        kept = F.filter("tasks", lambda t: outcome_filter(t["status"], options.filter_successful, options.filter_failed))
        fields.append(F.transform(kept, lambda t: F.struct(*task_fields(lambda n: t[n], options))).alias("tasks"))
    if options.include_metadata:
        fields.append(_metadata(F.col("metadata")))
    if options.include_system_info:
        fields.append(F.struct(rfc3339(F.current_timestamp()).alias("timestamp")).alias("system_info"))
    return nested.select(*fields)
