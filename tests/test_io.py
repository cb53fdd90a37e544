import json
import os

import pytest
from frames import rows
from pyspark.sql import functions as F

from runmetrics.operators import integrity
from runmetrics.sources import readers, writers

DUMPED = {
    "workflow_name": "wf", "run_id": "r1", "status": "PartialSuccess", "start_time": "2024-01-01T12:00:00Z", "end_time": "2024-01-01T12:00:10.500+00:00",
    "duration": {"secs": 10, "nanos": 500_000_000}, "metadata": {"k": "v"}, "summary": {"total_tasks": 1},
    "tasks": [{"task_id": "a", "task_type": "command", "status": "Timeout", "start_time": "2024-01-01T14:00:00+02:00", "end_time": None,
               "duration": {"secs": 1, "nanos": 5_000_000}, "output": "o", "error": None, "metadata": {}, "retry_count": 2}],
}
FORMATTED = {
    "workflow_name": "wf", "run_id": "r1", "status": "partial_success", "start_time": "2024-01-01T12:00:00+00:00", "end_time": "2024-01-01T12:00:10.500+00:00",
    "duration_seconds": 10.5, "metadata": {"k": "v"},
    "tasks": [{"task_id": "a", "task_type": "command", "status": "timeout", "start_time": "2024-01-01T12:00:00+00:00", "duration_seconds": 1.005, "output": "o", "retry_count": 2}],
}


def test_both_written_forms_read_alike(spark, tmp_path):
    for name, doc in (("a", DUMPED), ("b", FORMATTED)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "run.json").write_text(json.dumps(doc, indent=2))
    a, b = (readers.read_runs(spark, str(tmp_path / n)).collect() for n in "ab")
    assert a == b
    assert a[0].status == "partial_success" and a[0].duration_ms == 10_500 and a[0].tasks[0].duration_ms == 1_005


def test_missing_duration_comes_from_the_times(spark, tmp_path):
    doc = {k: v for k, v in DUMPED.items() if k != "duration"}
    (tmp_path / "run.json").write_text(json.dumps(doc))
    assert readers.read_runs(spark, str(tmp_path)).first().duration_ms == 10_500


def test_definitions_keep_their_order(spark, tmp_path):
    doc = {"workflow_name": "wf", "output_destination": "file:///x", "tasks": [{"task_id": "z", "task_type": "command"}, {"task_id": "a", "name": "A", "task_type": "slack", "depends_on": ["z"], "required": False}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    assert [(r.ordinal, r.task_id, r.name, list(r.depends_on), r.required) for r in readers.read_definitions(spark, str(tmp_path)).collect()] == [
        (0, "z", "z", [], True), (1, "a", "A", ["z"], False)]


def test_previous_outputs_are_kept(spark, tmp_path):
    path = str(tmp_path / "out")
    assert [writers.write(spark.range(n), path, keep_previous=True)[-1] for n in (1, 2, 3)] == ["1", "2", "3"]
    assert spark.read.parquet(path).groupBy("version").count().count() == 3


def test_fan_out_refuses_unknown_sinks(spark, tmp_path):
    import pytest

    with pytest.raises(ValueError, match="nowhere"):
        writers.fan_out(spark.range(1), [("nowhere", "x"), ("json", str(tmp_path))])


def test_csv_metrics_carry_nested_columns_as_json(spark, tmp_path):
    df = spark.range(1).select("id", F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    writers.write_metrics(df, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().m == '{"a":1}'


def test_file_digests_and_manifest_round_trip(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "x.txt").write_text("abc")
    (tmp_path / "sub" / "y z.log").write_text("")
    files = integrity.file_contents(spark, str(tmp_path))
    made = integrity.manifest(files, "md5")
    assert {r.path.rsplit("/", 1)[1]: (r.checksum, r.file_size) for r in made.collect()} == {
        "x.txt": ("900150983cd24fb0d6963f7d28e17f72", 3), "y z.log": ("d41d8cd98f00b204e9800998ecf8427e", 0)}
    assert integrity.exclude_globs(integrity.file_inventory(spark, str(tmp_path)), ["*.log"]).count() == 1
    assert integrity.file_contents(spark, str(tmp_path), max_length=1).filter("content is null").count() == 1
    assert rows(integrity.checksum_lines(made))[0][0].endswith("/x.txt")
    again = made.filter("file_size > 0").withColumn("checksum", F.lit("other"))
    assert [r[0] for r in rows(integrity.verify_manifest(again, made), "result")] == ["mismatch", "missing"]


def test_large_files_are_digested_in_pieces(spark, tmp_path):
    import hashlib

    content = bytes(range(256)) * 5000
    (tmp_path / "big file.bin").write_bytes(content)
    (tmp_path / "small.bin").write_bytes(b"abc")
    for as_base64 in (False, True):
        whole = integrity.file_manifest(spark, str(tmp_path), "sha512", as_base64)
        split = integrity.file_manifest(spark, str(tmp_path), "sha512", as_base64, max_length=100)
        assert rows(split, *whole.columns) == rows(whole)
    assert hashlib.md5(content).hexdigest() in {r.checksum for r in integrity.file_manifest(spark, str(tmp_path), "md5", max_length=100).collect()}


def test_unreadable_lines_are_told_apart(spark, tmp_path):
    (tmp_path / "runs.json").write_text(json.dumps(DUMPED) + "\n{not json\n" + json.dumps(FORMATTED) + "\n")
    assert readers.read_runs(spark, str(tmp_path), multiline=False).count() == 2
    assert [r.text for r in readers.rejected_runs(spark, str(tmp_path), multiline=False).collect()] == ["{not json"]


def test_listing_has_times_of_empty_files_and_skips_hidden_ones(spark, tmp_path):
    (tmp_path / "a" / "b c").mkdir(parents=True)
    (tmp_path / "a" / "b c" / "empty.log").write_text("")
    (tmp_path / "a" / "full.log").write_text("abc")
    (tmp_path / "a" / "_SUCCESS").write_text("")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "x.log").write_text("x")
    os.utime(tmp_path / "a" / "b c" / "empty.log", (1_000_000_000, 1_000_000_000))
    found = integrity.file_inventory(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in found.orderBy("path").collect()] == ["empty.log", "full.log"]
    scanned = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path", "length", "modificationTime")
    assert rows(found.filter("length > 0")) == rows(scanned)
    old = integrity.rotation_plan(found.withColumn("folder", F.lit("f")), integrity.Rotation(max_age_days=1), F.current_timestamp())
    assert {r.path.rsplit("/", 1)[1]: r.rotate for r in old.collect()} == {"empty.log": True, "full.log": False}
    assert integrity.file_inventory(spark, f"file:{tmp_path}/a/full.log").count() == 1
    assert integrity.file_inventory(spark, str(tmp_path), "*.txt").count() == 0


def test_listing_refuses_what_it_cannot_open(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)unrecognized filesystem"):
        integrity.file_inventory(spark, "nowhere://bucket/x")
    with pytest.raises(Exception, match="FileNotFoundError"):
        integrity.file_inventory(spark, str(tmp_path / "missing"))
