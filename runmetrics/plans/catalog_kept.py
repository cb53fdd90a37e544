"""Catalog: tables that are kept from load to load. Their rows must equal those of the queries that read everything."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import results, totals
from ..operators.kept import KeptResults
from ..session import configure, stored
from . import tables as t
from .catalog_io import scratch
from .catalog_metrics import _EXECUTION, END, START, _day
from .catalog_results import ts
from .oracle import ORACLE, QUERIES, rounded

LOADS = 3


def _kept(spark, sf, typed):
    """Attempts arrive in three loads, the middle one in two versions of the table; later attempts may come first."""
    configure(spark)
    attempts = t.task_attempts(spark, sf, typed)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = KeptResults(spark, scratch(spark), ["start_time", "l_partkey", "l_suppkey"], buckets=buckets, fold=0.8)
    for load in range(LOADS):
        kept.add(attempts.filter(F.pmod("l_partkey", F.lit(LOADS)) == load))
    return kept.read()


def _results(spark, sf):
    return _kept(spark, sf, True).select(
        "run_id", "task_id", "task_type", "status", ts("start_time").alias("start_time"), "duration_ms", "retry_count", "error")


def _run_facts(spark, sf):
    return results.run_facts(t.runs(spark, sf), _kept(spark, sf, False)).select(
        "run_id", "workflow_name", "status", "duration_ms", "total_tasks", "successful_tasks", "failed_tasks", "skipped_tasks",
        "cancelled_tasks", *rounded("success_rate"), ts("start_time").alias("start_time"), ts("end_time").alias("end_time"))


def _stored(spark, sf, typed=False):
    """Finished runs arrive in three loads, the last one twice, and are folded on the way."""
    runs, tasks = t.facts_and_tasks(spark, sf, typed)
    runs = stored(runs, "run-facts")
    kept = totals.StoredTotals(spark, scratch(spark), fold=2)
    for load in [*range(LOADS), LOADS - 1]:
        mine = F.pmod("run_id", F.lit(LOADS)) == load
        kept.add(f"load {load}", runs.filter(mine), tasks.filter(mine))
    return kept.rows()


def _running(spark, sf):
    out = totals.running_totals(_stored(spark, sf))
    return out.select(*[c for c in out.columns if not c.endswith("_rate")], *rounded("workflow_success_rate", "task_success_rate"))


def _execution(spark, sf):
    out = totals.execution_metrics(_stored(spark, sf), _day(START), _day(END))
    plain = [c for c in out.columns if c not in _EXECUTION and not c.startswith("period_")]
    return out.select(*plain, *rounded(*_EXECUTION), ts("period_start").alias("period_start"), ts("period_end").alias("period_end"))


def _breakdown(spark, sf):
    return totals.breakdown(_stored(spark, sf, True)).withColumns({c: F.round(c, 6) for c in ("avg_duration_ms", "success_rate", "avg_retry_count")})


for _name, _query, _equal in (
    ("J5_kept_results", _results, "J5_latest_per_task"), ("D6_kept_run_facts", _run_facts, "D6_run_facts"),
    ("A4_stored_totals", _running, "A4_running_totals"), ("A3_stored_metrics", _execution, "A3_execution_metrics"),
    ("A13_stored_breakdown", _breakdown, "A13_breakdown"),
):
    QUERIES[_name], ORACLE[_name] = _query, ORACLE[_equal]
