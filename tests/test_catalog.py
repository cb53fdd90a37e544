"""Registered queries next to their SQL. RUN_ALL=1 checks every one, else one per family."""

import os

import pytest

import __spark_entry__ as entry
import check
from runmetrics.plans import catalog

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "P7_project_runs P9_apply_filters P10_runs_triggering P21_critical_runs J2_fill_skipped J4_dependencies_met J5_latest_per_task "
    "J5_kept_results D6_kept_run_facts A3_stored_metrics A4_stored_totals A13_stored_breakdown G9_unreachable "
    "J7_verify_manifest J8_route_reports A3_execution_metrics A4_running_totals A6_performance_by_task_type A8_top_workflows "
    "A9_failure_patterns A13_breakdown D6_run_facts W1_retain_last_per_type W4_trends W5_retry_schedule W6_concurrency_profile "
    "W7_rate_limited W8_rotation_plan G3_cycles G5_dependency_path G13_skip_propagation A14_validate_definitions U3_merge_maps "
    "F7_format_time F15_duration_text F17_brace_error R1_render R2_render_map R5_run_summary R8_run_detailed R11_format_text "
    "S2_read_formatted_runs S4_read_definitions S10_fan_out T2_stream_period T8_stream_rate_limit"
).split()
NAMES = sorted(catalog.ORACLE) if os.environ.get("RUN_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    verdict, count, _, detail = check.compare(spark, con, name, SF)
    assert verdict == "ok" and count > 0, detail


def test_every_query_but_a_few_has_sql():
    rows_only = set(catalog.QUERIES) - set(catalog.ORACLE)
    assert rows_only == {"F9_uuid", "F11_sha512", "S5_file_inventory", "S5_file_digests"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
