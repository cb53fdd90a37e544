"""Reading run results and workflow definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schema
from ..functions.status import normalize_status
from ..functions.times import duration_between, parse_time


# Holds the text of a document that can't be read.
REJECTED = "_rejected"


def read_raw_runs(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Result files as written, with the fields of both written forms.

    ``multiline`` reads one document per file; without it every line is a document and
    large files are split over tasks. Compressed files are read by their extension.
    """
    fields = StructType([*schema.RAW_RUN.fields, StructField(REJECTED, StringType())])
    return spark.read.schema(fields).option("multiLine", multiline).option("columnNameOfCorruptRecord", REJECTED).json(path)


def _parsed() -> Column:
    """Always true, but makes the scan parse a field: Spark refuses scans of the rejected text alone."""
    return F.length(F.coalesce("workflow_name", F.lit(""))) >= 0


def rejected_runs(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """(file, text) of the documents that can't be read as a run."""
    raw = read_raw_runs(spark, path, multiline).withColumn("file", F.input_file_name())
    return raw.filter(_parsed() & F.col(REJECTED).isNotNull()).select("file", F.col(REJECTED).alias("text"))


def _duration_ms(parts: Column, seconds: Column) -> Column:
    from_parts = parts["secs"] * 1000 + F.floor(F.coalesce(parts["nanos"], F.lit(0)) / 1_000_000)
    return F.coalesce(from_parts, F.round(seconds * 1000).cast("long"))


def _end_based(duration: Column, start: Column, end: Column) -> Column:
    return F.coalesce(duration, duration_between(start, end))


def normalize_runs(raw: DataFrame) -> DataFrame:
    """Both written forms to the canonical one: snake case status, UTC times, milliseconds."""
    no_metadata = F.create_map().cast("map<string,string>")

    def task(t: Column) -> Column:
        start, end = parse_time(t["start_time"]), parse_time(t["end_time"])
        return F.struct(
            t["task_id"].alias("task_id"), t["task_type"].alias("task_type"),
            normalize_status(t["status"]).alias("status"), start.alias("start_time"), end.alias("end_time"),
            _end_based(_duration_ms(t["duration"], t["duration_seconds"]), start, end).alias("duration_ms"),
            t["output"].alias("output"), t["error"].alias("error"),
            F.coalesce(t["retry_count"], F.lit(0)).alias("retry_count"),
            F.coalesce(t["metadata"], no_metadata).alias("metadata"),
        )

    start, end = parse_time("start_time"), parse_time("end_time")
    return raw.select(
        "workflow_name", "run_id", normalize_status("status").alias("status"),
        start.alias("start_time"), end.alias("end_time"),
        _end_based(_duration_ms(F.col("duration"), F.col("duration_seconds")), start, end).alias("duration_ms"),
        F.coalesce("metadata", no_metadata).alias("metadata"),
        F.transform("tasks", task).alias("tasks"),
    )


def read_runs(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Runs of either written form, canonical, tasks nested. Unreadable documents are left to ``rejected_runs``."""
    return normalize_runs(read_raw_runs(spark, path, multiline).filter(_parsed() & F.col(REJECTED).isNull()))


def read_definitions(spark: SparkSession, path: str, fmt: str = "json", multiline: bool = True) -> DataFrame:
    """Workflow definitions, one row per task in declared order; unnamed tasks go by their id."""
    reader = spark.read.schema(schema.WORKFLOW_DEFINITION)
    if fmt == "json":
        reader = reader.option("multiLine", multiline)
    return explode_definitions(reader.format(fmt).load(path))


def explode_definitions(workflows: DataFrame) -> DataFrame:
    return workflows.select(
        "workflow_name", "output_destination", "continue_on_error",
        F.posexplode("tasks").alias("ordinal", "t"),
    ).select(
        "workflow_name", "output_destination", "continue_on_error", "ordinal",
        "t.task_id", F.coalesce("t.name", "t.task_id").alias("name"), "t.task_type",
        F.coalesce("t.depends_on", F.array().cast("array<string>")).alias("depends_on"),
        F.coalesce("t.required", F.lit(True)).alias("required"),
        "t.max_attempts", "t.initial_delay_ms", "t.backoff_multiplier", "t.when", "t.timeout_ms", "t.config",
    )


def read_table(spark: SparkSession, path: str, table_schema: StructType, fmt: str = "parquet") -> DataFrame:
    """A columnar table with a declared schema: no inference pass, and times load as UTC."""
    return spark.read.schema(table_schema).format(fmt).load(path)
