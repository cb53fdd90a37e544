"""Writing tables and reports.

Text outputs are written by Spark tasks, partitioned by report type and date. A replaced
output keeps its predecessor as an earlier ``version=`` folder.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.template import fill
from ..functions.text import sanitize_filename
from ..functions.times import clock_text
from ..operators.reports import SEPARATOR, report_file_name
from .snapshots import SnapshotLog

# Formats a metrics table can be written in.
FORMATS = ("json", "csv", "parquet", "orc")


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(jvm_path)]
    return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith("version="))


def _claimed(spark: SparkSession, path: str) -> int:
    """The next version of an output, taken in its log, so that no other writer gets the same number."""
    log = SnapshotLog(spark, path)
    while True:
        version = max([0, *_versions(spark, path), *log.versions()]) + 1
        if log.commit(version, {"folder": f"version={version}"}):
            return version


def write(
    df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet", keep_previous: bool = False,
    compression: str | None = None, partition_by: Sequence[str] = (),
) -> str:
    """Write a table; returns the folder written. Missing folders are created.

    ``keep_previous`` adds the next ``version=`` folder instead of replacing the content. Several writers may do so at
    once: each gets a number of its own.
    """
    if keep_previous:
        path = f"{path.rstrip('/')}/version={_claimed(df.sparkSession, path)}"
        mode = "errorifexists"
    writer = df.write.mode(mode).format(fmt)
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite", compression: str | None = None) -> str:
    return write(df, path, mode, "json", compression=compression)


def json_text(df: DataFrame, pretty: bool = False) -> Column:
    """Every row as one JSON text; null fields are left out."""
    return F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"pretty": str(pretty).lower()})


def write_metrics(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> str:
    """Write a metrics table. CSV has flat columns only, so nested ones are written as JSON text."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}, expected one of {FORMATS}")
    if fmt == "csv":
        nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("struct", "array", "map")]
        df = df.withColumns({n: F.to_json(n) for n in nested})
        df.write.mode(mode).option("header", True).csv(path)
        return path
    return write(df, path, mode, fmt)


def partition_layout(reports: DataFrame, template: str = "{title}_{timestamp}.txt") -> DataFrame:
    """Add the date to partition by and the sanitised file name of every report."""
    return reports.withColumns(
        {"date": F.date_format("generated_at", "yyyy-MM-dd"), "file_name": sanitize_filename(report_file_name(template))}
    )


def write_reports(reports: DataFrame, path: str, append: bool = False, compression: str | None = None) -> str:
    """Write report texts below ``report_type=/date=``; appended ones start with a time line."""
    laid_out = partition_layout(reports)
    text = F.col("content")
    if append:
        text = F.concat(fill(SEPARATOR, at=clock_text("generated_at")), text, F.lit("\n"))
    writer = laid_out.select("report_type", "date", text.alias("value")).write.mode("append" if append else "overwrite")
    if compression:
        writer = writer.option("compression", compression)
    writer.partitionBy("report_type", "date").text(path)
    return path


Sink = Callable[[DataFrame], object]
SINKS: dict[str, Callable[..., object]] = {}


def register_sink(name: str, fn: Callable[..., object]) -> None:
    """Add a destination: a function from (frame, target) that writes it."""
    SINKS[name] = fn


register_sink("json", lambda df, target: write_json(df, target))
register_sink("parquet", lambda df, target: write(df, target))
register_sink("csv", lambda df, target: write_metrics(df, target, "csv"))
register_sink("text", lambda df, target: write_reports(df, target))
register_sink("append", lambda df, target: write(df, target, "append"))


def fan_out(df: DataFrame, destinations: Sequence[tuple[str, str]], sinks: Mapping[str, Callable[..., object]] | None = None) -> None:
    """Write one frame to several (sink, target) destinations, computing it once."""
    known = SINKS if sinks is None else sinks
    unknown = [name for name, _ in destinations if name not in known]
    if unknown:
        raise ValueError(f"unknown destinations {unknown}, known: {sorted(known)}")
    shared = df.persist(StorageLevel.MEMORY_AND_DISK) if len(destinations) > 1 else df
    try:
        for name, target in destinations:
            known[name](shared, target)
    finally:
        if shared is not df or len(destinations) > 1:
            shared.unpersist()
