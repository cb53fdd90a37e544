from frames import rows, runs, task, tasks
from pyspark.sql import functions as F

from runmetrics.operators import metrics, results, routing
from runmetrics.functions.times import utc

CASES = {
    "single": (["success"], "success", 100.0),
    "with failure": (["success", "failed"], "partial_success", 50.0),
    "all skipped": (["skipped", "skipped"], "success", 0.0),
    "timeout only": (["timeout"], "failed", 0.0),
    "cancelled only": (["cancelled"], "failed", 0.0),
    "still running": (["success", "failed", "running"], "running", 100 / 3),
    "empty": ([], "success", 0.0),
}


def _frames(spark):
    made = [task(run, f"t{i}", s, i) for run, (statuses, _, _) in CASES.items() for i, s in enumerate(statuses)]
    return runs(spark, *CASES), tasks(spark, made)


def test_run_facts_of_the_fixed_cases(spark):
    r, t = _frames(spark)
    got = {x.run_id: (x.status, round(x.success_rate, 6)) for x in results.run_facts(r, t).collect()}
    assert got == {run: (status, round(rate, 6)) for run, (_, status, rate) in CASES.items()}
    status = {x.run_id: x.status for x in results.run_status(t, r).collect()}
    assert status == {run: s for run, (_, s, _) in CASES.items()}


def test_summary_counts_timeouts_as_failed_and_cancelled_apart(spark):
    t = tasks(spark, [task("r", str(i), s) for i, s in enumerate(["success", "failed", "timeout", "cancelled", "skipped"])])
    assert rows(results.run_summary(t), "total_tasks", "successful_tasks", "failed_tasks", "skipped_tasks", "cancelled_tasks") == [(5, 1, 2, 1, 1)]


def test_nested_and_flat_summaries_agree(spark):
    _, t = _frames(spark)
    nested = t.groupBy("run_id").agg(F.collect_list(F.struct("task_id", "status")).alias("tasks")).select("run_id", *results.nested_summary())
    flat = results.run_summary(t)
    assert rows(nested, *flat.columns) == rows(flat, *flat.columns)


def test_last_result_of_a_task_wins(spark):
    import datetime as dt
    from frames import START

    t = tasks(spark, [task("r", "a", "failed"), task("r", "a", "success", start=START + dt.timedelta(hours=1)), task("r", "b", "failed")])
    assert rows(results.latest_per_task(t, ["start_time"]), "task_id", "status") == [("a", "success"), ("b", "failed")]


def test_missing_results_become_skipped(spark):
    defs = spark.createDataFrame([("wf", t, "command", t != "d") for t in "abcd"], "workflow_name string, task_id string, task_type string, required boolean")
    t = tasks(spark, [task("r", "a", "success"), task("r", "b", "failed"), task("r", "d", "success")])
    full = results.fill_skipped(runs(spark, "r"), t, defs)
    assert rows(full, "task_id", "status", "error") == [
        ("a", "success", None), ("b", "failed", None), ("c", "skipped", "Dependencies failed"), ("d", "success", None)]


def test_dependencies_met(spark):
    t = tasks(spark, [task("r", "a", "success"), task("r", "b", "failed"), task("r", "c", "pending"), task("r", "d", "pending"), task("r", "e", "pending")])
    edges = spark.createDataFrame([("r", "a", "c"), ("r", "a", "d"), ("r", "b", "d"), ("r", "gone", "e")], "run_id string, src string, dst string")
    got = dict(rows(results.dependencies_met(t, edges), "task_id", "dependencies_met"))
    assert got == {"a": True, "b": True, "c": True, "d": False, "e": False}


def test_critical_failures(spark):
    defs = spark.createDataFrame([("wf", "a", True), ("wf", "b", False)], "workflow_name string, task_id string, required boolean")
    t = tasks(spark, [task("r1", "a", "success"), task("r1", "b", "failed"), task("r2", "a", "timeout"), task("r2", "b", "success")])
    stops = lambda **o: dict(rows(results.critical_runs(t, defs, **o), "run_id", "must_stop"))
    assert stops() == {"r1": False, "r2": True}
    assert stops(continue_on_error=True) == {"r1": False, "r2": True}
    assert stops(continue_on_error=False) == {"r1": True, "r2": True}


def test_conditions_skip_tasks(spark):
    t = tasks(spark, [task("r", "a", "success"), task("r", "b", "success", retry=2), task("r", "c", "success")])
    out = results.apply_when(t, {"a": "retry_count > 1", "b": "retry_count > 1", "c": "cast(null as boolean)"})
    assert rows(out, "task_id", "status", "error") == [
        ("a", "skipped", "Condition not met"), ("b", "success", None), ("c", "skipped", "Condition not met")]


def test_filters_pass_unknown_durations_and_need_all_tags(spark):
    t = tasks(spark, [
        task("r", "a", "success", seconds=5.9, metadata={"env": "prod"}), task("r", "b", "success", seconds=None, metadata={"env": "prod"}),
        task("r", "c", "success", seconds=9, metadata={"env": "prod"}), task("r", "d", "success", seconds=5, metadata={})])
    kept = routing.apply_filters(t, routing.Filters(max_duration_seconds=5, tags={"env": "prod"}))
    assert rows(kept, "task_id") == [("a",), ("b",)]


def test_task_triggers_need_a_failure(spark):
    t = tasks(spark, [task("r", s, s.lower()) for s in ("Failed", "Timeout", "Success")])
    route = routing.Route("x", trigger_on_task_failure=True)
    assert rows(routing.tasks_triggering(t, [route]), "task_id") == [("Failed",), ("Timeout",)]
    assert routing.tasks_triggering(t, []).count() == 0


def test_unknown_channels_are_an_error(spark):
    import pytest

    with pytest.raises(ValueError, match="pigeon"):
        routing.check_channels([routing.Route("x", channels=(routing.Channel("pigeon"),))])


def test_period_metrics_and_running_totals_differ_on_partial_success(spark):
    r, t = _frames(spark)
    facts = results.run_facts(r, t)
    period = metrics.execution_metrics(facts, t, utc("2024-01-01"), utc("2024-01-02")).first()
    total = metrics.running_totals(facts, t).first()
    assert (period.successful_workflows, period.failed_workflows) == (3, 2)
    assert total.successful_workflows == 4
    assert period.timeout_tasks == 1 and period.total_tasks == 10
    empty = metrics.execution_metrics(facts, t, utc("2030-01-01"), utc("2030-01-02")).first()
    assert (empty.total_workflows, empty.workflow_success_rate, empty.avg_task_duration_ms) == (0, 0.0, None)


def test_failure_patterns_share_all_failures(spark):
    t = tasks(spark, [task("r", "a", "failed", error="E1: x"), task("r", "b", "timeout", error="E1: y"), task("r", "c", "failed", error="plain"),
                      task("r", "d", "cancelled"), task("r", "e", "success", error="E1: no")])
    assert rows(metrics.failure_patterns(t), "error_type", "count", "percentage") == [("E1", 2, 50.0), ("Unknown error", 1, 25.0), ("plain", 1, 25.0)]


def test_retention_keeps_the_newest(spark):
    r = spark.range(5).select(F.col("id").alias("run_id"), F.timestamp_seconds("id").alias("start_time"))
    assert rows(metrics.retain_last(r, 2), "run_id") == [(3,), (4,)]


def test_history_is_newest_first(spark):
    r = spark.range(5).select(F.col("id").alias("run_id"), F.lit("wf").alias("workflow_name"), F.timestamp_seconds("id").alias("start_time"))
    assert [x.run_id for x in metrics.history(r, "wf", limit=3).collect()] == [4, 3, 2]


def test_trends(spark):
    made = [("2024-01-01", 100.0, 50.0, 90.0, 10), ("2024-01-02", 80.0, 51.0, 80.0, 20), ("2024-01-04", 80.0, None, 80.0, 20)]
    series = spark.createDataFrame(made, "d string, avg_workflow_duration_ms double, avg_task_duration_ms double, workflow_success_rate double, total_workflows long")
    out = metrics.trends(series.withColumn("period_start", F.to_timestamp("d")), "daily")
    names = ["workflow_duration_trend", "task_duration_trend", "success_rate_trend", "throughput_trend"]
    assert rows(out, F.dayofmonth("period_start"), *names) == [
        (1, *["unknown"] * 4), (2, "improving", "stable", "degrading", "improving"), (4, *["unknown"] * 4)]


def test_concurrency(spark):
    import datetime as dt
    from frames import START

    at = lambda h: START + dt.timedelta(hours=h)
    t = tasks(spark, [
        task("r", "a", "success", seconds=7200), task("r", "b", "success", seconds=3600, start=at(1)),
        task("r", "c", "success", seconds=86400, start=at(2)), task("r", "d", "running", seconds=None, start=at(3)),
        task("r", "e", "success", seconds=0, start=at(3))])
    out = metrics.concurrency_profile(t, 4)
    assert rows(out, "peak_running", "current_running", "peak_utilization") == [(2, 1, 50.0)]


def test_conditions_are_data_of_each_workflow(spark):
    t = tasks(spark, [task("r", "a", "success", retry=10, workflow="w"), task("s", "a", "success", retry=9, workflow="v"), task("s", "b", "failed", workflow="v", error="E")])
    made = spark.createDataFrame(
        [("w", "a", ("retry_count", ">", "9")), ("v", "a", ("retry_count", ">", "9")), ("v", "b", None)],
        "workflow_name string, task_id string, when struct<field:string,comparison:string,value:string>")
    out = results.apply_conditions(t, made, ["retry_count", "status", "output"])
    assert rows(out, "run_id", "task_id", "status", "error") == [("r", "a", "success", None), ("s", "a", "skipped", "Condition not met"), ("s", "b", "failed", "E")]
    for condition, holds in ((("status", "=", "success"), True), (("status", "!=", "success"), False), (("status", "<", "t"), True), (("nothing", "=", "1"), None),
                             (("status", "like", "s"), None), (("output", "=", "x"), None), (("retry_count", "<=", None), None), (("retry_count", ">=", "10.0"), True)):
        row = t.filter("run_id = 'r'").withColumn("w", F.struct(*[F.lit(x).cast("string").alias(n) for n, x in zip(("field", "comparison", "value"), condition)]))
        assert row.select(results.condition_holds(F.col("w"), ["retry_count", "status", "output"]).alias("h")).first().h is holds, condition
