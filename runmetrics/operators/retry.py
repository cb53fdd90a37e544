"""Retry schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.times import backoff_delay

# Retry settings of a task without any, and of one that leaves fields out.
DEFAULT_ATTEMPTS_WITHOUT_CONFIG, DEFAULT_ATTEMPTS = 3, 1
DEFAULT_DELAY_MS, DEFAULT_MULTIPLIER, MAX_DELAY_MS = 1000, 2.0, 300_000


def with_retry_defaults(definitions: DataFrame, without_config: int = DEFAULT_ATTEMPTS_WITHOUT_CONFIG) -> DataFrame:
    """Fill missing retry fields; a task with no retry field at all gets more attempts."""
    any_set = F.coalesce(
        F.col("max_attempts").cast("double"), F.col("initial_delay_ms").cast("double"), F.col("backoff_multiplier")
    ).isNotNull()
    attempts = F.coalesce("max_attempts", F.when(any_set, DEFAULT_ATTEMPTS).otherwise(without_config))
    return definitions.withColumns(
        {
            "max_attempts": attempts,
            "initial_delay_ms": F.coalesce("initial_delay_ms", F.lit(DEFAULT_DELAY_MS).cast("long")),
            "backoff_multiplier": F.coalesce("backoff_multiplier", F.lit(DEFAULT_MULTIPLIER)),
        }
    )


def retry_schedule(definitions: DataFrame, keys=("workflow_name", "task_id"), max_delay_ms: int = MAX_DELAY_MS) -> DataFrame:
    """One row per possible retry: its delay and the total time waited by then."""
    keys = list(keys)
    retries = F.when(F.col("max_attempts") >= 2, F.sequence(F.lit(0), F.col("max_attempts") - 2))
    rows = with_retry_defaults(definitions).select(
        *keys, "initial_delay_ms", "backoff_multiplier", F.explode(retries).alias("attempt")
    ).withColumn(
        "delay_ms",
        backoff_delay(F.col("attempt"), F.col("initial_delay_ms"), F.col("backoff_multiplier"), max_delay_ms),
    )
    waited = Window.partitionBy(*keys).orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*keys, "attempt", "delay_ms", F.sum("delay_ms").over(waited).alias("total_wait_ms"))
