"""Canonical table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B, _TS = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)
_MAP = T.MapType(_S, _S)


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


TASK = _struct(
    ("task_id", _S), ("task_type", _S), ("status", _S), ("start_time", _TS), ("end_time", _TS),
    ("duration_ms", _L), ("output", _S), ("error", _S), ("retry_count", _I), ("metadata", _MAP),
)

TASK_RUN = T.StructType(
    [T.StructField("run_id", _S), T.StructField("workflow_name", _S), T.StructField("ordinal", _I), *TASK.fields]
)

RUN = _struct(
    ("workflow_name", _S), ("run_id", _S), ("status", _S), ("start_time", _TS), ("end_time", _TS),
    ("duration_ms", _L), ("metadata", _MAP), ("tasks", T.ArrayType(TASK)),
)

SUMMARY = _struct(
    ("total_tasks", _L), ("successful_tasks", _L), ("failed_tasks", _L), ("skipped_tasks", _L),
    ("cancelled_tasks", _L), ("success_rate", _D),
)

_DURATION_PARTS = _struct(("secs", _L), ("nanos", _L))

# Both written forms of a run at once: "duration" comes from one, "duration_seconds"
# from the other. Times are read as text and parsed by normalize_runs.
RAW_TASK = _struct(
    ("task_id", _S), ("task_type", _S), ("status", _S), ("start_time", _S), ("end_time", _S),
    ("duration", _DURATION_PARTS), ("duration_seconds", _D), ("output", _S), ("error", _S),
    ("retry_count", _I), ("metadata", _MAP),
)
RAW_RUN = _struct(
    ("workflow_name", _S), ("run_id", _S), ("status", _S), ("start_time", _S), ("end_time", _S),
    ("duration", _DURATION_PARTS), ("duration_seconds", _D), ("summary", SUMMARY),
    ("tasks", T.ArrayType(RAW_TASK)), ("metadata", _MAP),
)

DEFINED_TASK = _struct(
    ("task_id", _S), ("name", _S), ("task_type", _S), ("depends_on", T.ArrayType(_S)),
    ("required", _B), ("max_attempts", _I), ("initial_delay_ms", _L), ("backoff_multiplier", _D),
    ("when", _S), ("timeout_ms", _L), ("config", _S),
)
WORKFLOW_DEFINITION = _struct(
    ("workflow_name", _S), ("output_destination", _S), ("continue_on_error", _B),
    ("variables", _MAP), ("tasks", T.ArrayType(DEFINED_TASK)),
)

REPORT = _struct(
    ("report_type", _S), ("title", _S), ("content", _S), ("metadata", _MAP), ("generated_at", _TS),
)
