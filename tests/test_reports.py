from frames import rows, runs, task, tasks
import pytest
from pyspark.sql import functions as F

from runmetrics.functions.times import utc
from runmetrics.operators import metrics, output, reports, results, route_reports, routing

AT = "2024-05-06 07:08:09"


def _facts(spark, made):
    t = tasks(spark, made)
    return results.run_facts(runs(spark, "r"), t), t


def test_run_summary_text(spark):
    made = [task("r", f"t{i}", "failed" if i < 7 else "success", i, error=None if i else "boom") for i in range(8)]
    facts, t = _facts(spark, made)
    report = reports.report_run_summary(facts, t, at=utc(AT)).first()
    assert report.title == "Workflow Summary: wf - partial_success"
    assert report.content == (
        "ℹ️ **Workflow Summary**\n\n**Workflow:** wf\n**Run ID:** r\n**Status:** partial_success (took 10.0s)\n"
        "**Started:** 2024-01-01 12:00:00 UTC\n**Completed:** 2024-01-01 12:00:10 UTC\n\n**Task Summary:**\n- Total: 8\n"
        "- Successful: 1 (12.5%)\n- Failed: 7\n- Skipped: 0\n\n**Failed Tasks:**\n- t0 (command): boom\n"
        + "".join(f"- t{i} (command): Unknown error\n" for i in range(1, 5)) + "- ... and 2 more\n")
    nested = t.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "task_id", "task_type", "status", "error"))).alias("tasks"))
    again = reports.report_nested_summary(
        facts.drop("total_tasks", "successful_tasks", "failed_tasks", "skipped_tasks", "cancelled_tasks", "success_rate").join(nested, "run_id"), at=utc(AT))
    assert again.first().content == report.content


def test_task_summary_cuts_long_output(spark):
    _, t = _facts(spark, [task("r", "a", "success", output="x" * 300, retry=2)])
    content = reports.report_task_summary(t).first().content
    assert "**Output:**\n```\n" + "x" * 200 + "...\n```\n" in content and "**Retries:** 2\n" in content


def test_detailed_report_pages_lose_nothing(spark):
    made = [task("r", f"t{i:02d}", "success", i, metadata={"k": "v"}) for i in range(25)]
    facts, t = _facts(spark, made)
    whole = reports.report_run_detailed(facts, t)
    pages = reports.report_run_detailed(facts, t, per_page=10).orderBy("page").collect()
    assert [p.page for p in pages] == [0, 1, 2]
    assert "".join(p.content for p in pages) == whole.first().content
    assert whole.first().content.count("### ✅") == 25 and "**Metadata:**\n- k: v\n" in whole.first().content


def test_detailed_report_ends_with_run_metadata(spark):
    facts, t = _facts(spark, [task("r", "a", "success")])
    with_metadata = facts.withColumn("metadata", F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))
    assert reports.report_run_detailed(with_metadata, t).first().content.endswith("## Workflow Metadata\n- a: 1\n- b: 2\n")


def test_listing_keeps_both_outcomes(spark):
    facts, t = _facts(spark, [task("r", "a", "success", 0, output="one\ntwo"), task("r", "b", "failed", 1, error="E"), task("r", "c", "skipped", 2)])
    text = reports.format_text(facts, t, successful=True, failed=True, max_output_length=5).first().content
    assert "  ✓ a (command) [1.00s]\n      Output: one\n      t... [truncated]\n\n" in text
    assert "  ✗ b (command) [1.00s]\n      Error: E\n\n" in text and " c (command)" not in text


def test_projection_filters_nested_tasks(spark):
    _, t = _facts(spark, [task("r", "a", "success"), task("r", "b", "failed")])
    nested = t.groupBy("run_id", "workflow_name").agg(F.collect_list(F.struct(*[c for c in t.columns if c not in ("run_id", "workflow_name", "ordinal")])).alias("tasks"))
    nested = nested.withColumns({"status": F.lit("failed"), "start_time": F.current_timestamp(), "end_time": F.current_timestamp(), "duration_ms": F.lit(1)})
    out = output.project_runs(nested, output.OutputOptions(filter_successful=True)).first()
    assert [x.task_id for x in out.tasks] == ["a"] and out.summary.total_tasks == 2
    assert "tasks" not in output.project_runs(nested, output.OutputOptions(include_task_results=False)).columns


def test_generators_know_their_data(spark):
    with pytest.raises(ValueError, match="cannot report run"):
        reports.generate_reports("metrics", "run")
    facts, t = _facts(spark, [task("r", "a", "success")])
    period = metrics.execution_metrics(facts, t, utc("2024-01-01"), utc("2024-01-02"))
    made = reports.generate_reports("detailed", "period", metrics=period, period="daily", at=utc(AT)).first()
    assert made.title == "Detailed Daily default Report" and "- Average duration: 10.0s\n" in made.content


def test_messages_are_cut_for_chat(spark):
    made = spark.createDataFrame([("summary", "T", "x" * 2000, {}, None)], "report_type string, title string, content string, metadata map<string,string>, generated_at timestamp")
    text = made.select(reports.message_text().alias("m")).first().m
    assert text == "📋 *T*\n\n" + "x" * 1500 + "...\n\n_(Content truncated)_"


def test_routes_deliver_to_enabled_channels(spark):
    route = routing.Route("a", channels=(routing.Channel("file", "/x"), routing.Channel("email", "y", enabled=False)))
    made = spark.createDataFrame([("a", 1), ("b", 2)], "route string, id int")
    assert rows(routing.route_reports(made, [route, routing.Route("b")]), "id", "channel", "target") == [(1, "file", "/x")]


def _routes(**changes):
    return [routing.Route("t", "template", trigger_on_workflow_completion=True, **changes)]


def test_routes_choose_template_variables_and_title(spark):
    facts, t = _facts(spark, [task("r", "a", "success"), task("r", "b", "failed")])
    own = _routes(template_content="{{a}} {{b}} {{status}} {{workflow.summary.total_tasks}}{{absent}}", variables={"a": "1", "status": "x", "title": "T"})
    made = route_reports.report_routes("run", facts, own, t, {"t": "unused"}, {"a": "0", "b": "2", "title": "U"}, utc(AT)).first()
    assert (made.content, made.title, made.report_type, made.route) == ("1 2 partial_success 2", "T", "template", "t")
    assert made.metadata["template_var_a"] == "1" and made.metadata["data_type"] == "workflow_completion"
    named = route_reports.report_routes("run", facts, _routes(template_file="/f"), t, {"t": "named"}, at=utc(AT), read=lambda path: "file " + path)
    filed = route_reports.report_routes("run", facts, _routes(template_file="/f"), t, at=utc(AT), read=lambda path: "file " + path)
    assert named.first().content == "named" and filed.first().content == "file /f"
    assert named.first().title == "t - wf - Workflow partial_success Report"
    with pytest.raises(ValueError, match="no template content found for route 't'"):
        route_reports.report_routes("run", facts, _routes(), t)
    with pytest.raises(ValueError, match="no routes"):
        route_reports.report_routes("run", facts, [], t)


def test_routes_make_their_kind_of_report(spark):
    facts, t = _facts(spark, [task("r", "a", "success"), task("r", "b", "failed", 1), task("s", "c", "running", seconds=None)])
    routes = [*_routes(template_content="x"), routing.Route("d", "detailed", trigger_on_workflow_completion=True, filters=routing.Filters(task_status=["Failed"])),
              routing.Route("s", "summary", trigger_on_workflow_completion=True)]
    made = route_reports.report_routes("run", facts, routes, t, at=utc(AT))
    assert rows(made, "run_id", "route", "report_type") == [("r", "d", "detailed"), ("r", "s", "summary"), ("r", "t", "template")]
    assert "### ❌ b" in made.filter("route = 'd'").first().content and " a (" not in made.filter("route = 'd'").first().content
    off = route_reports.report_routes("run", facts, routes, t, at=utc(AT), switches=routing.Switches(workflow_completion_reports=False))
    assert off.count() == 0


def test_nested_detailed_reports_follow_the_filters_of_their_route(spark):
    made = [task("r", f"t{i}", "failed" if i % 2 else "success", i, seconds=float(i), metadata={"team": "a" if i < 4 else "b"}) for i in range(8)]
    facts, t = _facts(spark, made)
    fields = [c for c in t.columns if c not in ("run_id", "workflow_name", "ordinal")]
    nested = t.groupBy("run_id").agg(F.collect_list(F.struct(*fields)).alias("tasks"))
    whole = facts.drop("total_tasks", "successful_tasks", "failed_tasks", "skipped_tasks", "cancelled_tasks", "success_rate").join(nested, "run_id")
    routes = [
        routing.Route("all", "detailed", trigger_on_workflow_completion=True),
        routing.Route("failed", "detailed", trigger_on_workflow_completion=True, filters=routing.Filters(task_status=["failed"], min_duration_seconds=3)),
        routing.Route("team", "detailed", trigger_on_workflow_completion=True, filters=routing.Filters(tags={"team": "b"})),
        routing.Route("short", "summary", trigger_on_workflow_completion=True)]
    found = {r.route: r.content for r in route_reports.report_nested_routes(whole, routes, at=utc(AT)).collect()}
    batch = {r.route: r.content for r in route_reports.report_routes("run", facts, routes, t, at=utc(AT)).collect()}
    shown = lambda text: [i for i in range(8) if f"t{i}" in text]
    assert shown(found["all"]) == list(range(8)) and shown(found["failed"]) == [3, 5, 7] and shown(found["team"]) == [4, 5, 6, 7]
    assert all(shown(found[name]) == shown(batch[name]) for name in ("all", "failed", "team"))


def test_period_routes_report_their_own_period(spark):
    facts, t = _facts(spark, [task("r", "a", "failed"), task("r", "b", "success")])
    series = metrics.period_series(facts, t, "daily")
    routes = [
        routing.Route("day", period="daily"), routing.Route("deep", "detailed", period="daily"), routing.Route("json", "metrics", period="daily"),
        routing.Route("text", "template", period="daily", template_file="/f"), routing.Route("month", period="monthly"),
        routing.Route("off", period="daily", enabled=False), routing.Route("run", trigger_on_workflow_completion=True),
    ]
    # a template that only another period needs isn't read
    routes.append(routing.Route("other", "template", period="weekly"))
    off = routing.Switches(workflow_completion_reports=False, task_completion_reports=False)
    made = route_reports.report_routes("period", series, routes, at=utc(AT), period="daily", read=lambda _: "{{period}} {{total_tasks}}", switches=off)
    assert rows(made, "route", "report_type") == [("day", "summary"), ("deep", "detailed"), ("json", "metrics"), ("text", "template")]
    found = {r.route: r for r in made.collect()}
    assert found["text"].content == "Daily 2" and found["day"].content == found["deep"].content == reports.report_period(series.withColumn("period_end", F.expr("period_start + interval 1 day")), "daily", at=utc(AT)).first().content
    assert route_reports.report_routes("period", series.limit(0), routes[:3], at=utc(AT), period="daily").count() == 0
    with pytest.raises(ValueError, match="unknown period"):
        route_reports.report_routes("period", series, routes, at=utc(AT))
    with pytest.raises(ValueError, match="no routes"):
        route_reports.report_routes("period", series, routes, at=utc(AT), period="hourly")
