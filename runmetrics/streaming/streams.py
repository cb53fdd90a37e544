"""Streaming jobs over run and task completions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.status import is_failed, success_rate
from ..operators import reports, routing
from ..operators.route_reports import report_nested_routes, report_routes
from ..operators.windows import join_null_safe
from ..sources.writers import SINKS, fan_out
from .state import admit, retain_newest


def read_run_stream(
    spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", glob: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """New files of a folder as a stream; the schema is declared, never inferred."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def _counters(partial_is_success: bool) -> list[Column]:
    status = F.col("status")
    good = ("success", "partial_success") if partial_is_success else ("success",)
    return [
        F.count("*").alias("total"),
        F.count_if(status.isin(*good)).alias("successful"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == "skipped").alias("skipped"),
        F.count_if(status == "cancelled").alias("cancelled"),
    ]


def stream_totals(completions: DataFrame, keys: Sequence[str] = (), partial_is_success: bool = True) -> DataFrame:
    """Totals updated by every completion."""
    return completions.groupBy(*keys).agg(*_counters(partial_is_success)).withColumn(
        "success_rate", success_rate("successful", "total")
    )


def stream_period(
    completions: DataFrame, span: str = "1 hour", watermark: str = "10 minutes", on: str = "start_time",
    keys: Sequence[str] = (), partial_is_success: bool = False,
) -> DataFrame:
    """Metrics per clock period, final once the watermark has passed the period."""
    windowed = completions.withWatermark(on, watermark).groupBy(F.window(on, span), *keys)
    counted = windowed.agg(*_counters(partial_is_success), F.avg("duration_ms").alias("avg_duration_ms"))
    return counted.select(
        F.col("window.start").alias("period_start"), F.col("window.end").alias("period_end"), *keys,
        "total", "successful", "failed", "skipped", "cancelled", "avg_duration_ms",
        success_rate("successful", "total").alias("success_rate"),
    )


def stream_distinct(completions: DataFrame, keys: Sequence[str], on: str = "start_time", watermark: str = "1 hour") -> DataFrame:
    """Drop exact repeats that arrive within the watermark."""
    return completions.withWatermark(on, watermark).dropDuplicatesWithinWatermark(list(keys))


def stream_latest(completions: DataFrame, keys: Sequence[str], order: Sequence[str], ttl_ms: int | None = None) -> DataFrame:
    """The latest result of every task.

    An aggregation with map-side combine; with ``ttl_ms`` the state of a task is dropped
    after that time without results, which bounds it.
    """
    if ttl_ms is not None:
        return retain_newest(completions, keys, order, 1, ttl_ms).drop("position")
    others = [c for c in completions.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(*order))
    return completions.groupBy(*keys).agg(newest.alias("latest")).select(*keys, "latest.*")


def stream_retain(completions: DataFrame, n: int, keys: Sequence[str], order: Sequence[str], ttl_ms: int | None = None) -> DataFrame:
    """The newest n results of every key."""
    return retain_newest(completions, keys, order, n, ttl_ms)


def stream_failures(tasks: DataFrame, template: str = "default", at: Column | None = None) -> DataFrame:
    """A report for every failed task."""
    return reports.report_task_summary(tasks.filter(is_failed("status")), template, at)


def stream_task_reports(
    tasks: DataFrame, routes: Sequence[routing.Route], at: Column | None = None, named: Mapping[str, str] | None = None,
    variables: Mapping[str, str] | None = None, read: Callable[[str], str] | None = None, switches: routing.Switches = routing.Switches(),
) -> DataFrame:
    """Reports of failed tasks, one per triggered route, by the generator, filters and template that the route names."""
    return report_routes("task", tasks, routes, None, named, variables, at, read, switches)


def stream_run_reports(
    nested: DataFrame, routes: Sequence[routing.Route], at: Column | None = None, named: Mapping[str, str] | None = None,
    variables: Mapping[str, str] | None = None, read: Callable[[str], str] | None = None, switches: routing.Switches = routing.Switches(),
) -> DataFrame:
    """Reports of finished runs, one per triggered route, by the generator, filters and template that the route names.

    ``read`` gives the text of template files, once when the query starts; ``switches`` may turn the reports off.
    """
    return report_nested_routes(nested, routes, named, variables, at, read, switches)


def stream_rate_limit(
    messages: DataFrame, limits: routing.RateLimits, keys: Sequence[str] = ("channel",), at: str = "generated_at",
    tie: Sequence[str] = (), ttl_ms: int | None = None, late: str | None = None,
) -> DataFrame:
    """Let only the first reports of every minute, hour and day of a key through.

    ``late``, an interval, bounds the state: reports that come later than that are left out.
    """
    return admit(messages, keys, at, [at, *tie], limits.spans(), ttl_ms, late)


def write_append(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """Append rows to files, exactly once."""
    writer = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)


def write_updates(df: DataFrame, path: str, checkpoint: str, mode: str = "update", available_now: bool = True) -> StreamingQuery:
    """Write the changed rows of every batch to a folder of its own.

    A batch that is run again after a failure replaces its own folder.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_updates(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str] = ()) -> DataFrame:
    """The state the updates add up to: for every key the rows of its last batch."""
    fields = StructType(schema.fields)
    rows = spark.read.schema(fields.add("batch", "long")).parquet(path)
    newest = F.max("batch").alias("batch")
    last = rows.groupBy(*keys).agg(newest)
    return join_null_safe(rows, last, [*keys, "batch"]).drop("batch")


def stream_fan_out(df: DataFrame, destinations: Sequence[tuple[str, str]], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Send every batch to several (sink, folder) destinations, computing it once."""

    def save(batch: DataFrame, batch_id: int) -> None:
        # a batch that is run again replaces its own folders, also where the sink would append
        replacing = {**SINKS, "append": SINKS["parquet"]}
        fan_out(batch, [(sink, f"{target}/batch={batch_id}") for sink, target in destinations], replacing)

    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
