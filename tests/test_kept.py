"""Tables kept from load to load, and the log of their versions."""

import random
import threading
import uuid

import pytest
from frames import rows
from pyspark.sql import functions as F

from runmetrics.operators import metrics, totals
from runmetrics.operators.kept import KeptResults
from runmetrics.operators.results import latest_per_task
from runmetrics.session import shared_dir
from runmetrics.sources import writers
from runmetrics.sources.snapshots import SnapshotLog

ATTEMPT = "run_id string, task_id string, at int, status string"


def folder(spark):
    return f"{shared_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"


def attempts(seed, n=400):
    rnd = random.Random(seed)
    made = [(None if rnd.random() < 0.02 else f"r{rnd.randrange(20)}", None if rnd.random() < 0.02 else f"t{rnd.randrange(9)}") for _ in range(n)]
    order = rnd.sample(range(100_000), n)
    return [(run, task, at * 10 + seed, rnd.choice(("success", "failed", None))) for (run, task), at in zip(made, order)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kept_results_equal_the_batch(spark):
    kept = KeptResults(spark, folder(spark), ["at"], buckets=4, fold=10.0)
    seen = []
    with pytest.raises(LookupError):
        kept.read()
    for load in range(4):
        new = attempts(load)
        seen += new
        kept.add(spark.createDataFrame(new, ATTEMPT))
        if load == 2:
            kept.compact()
        expected = latest_per_task(spark.createDataFrame(seen, ATTEMPT), ["at"])
        assert sorted(map(str, kept.read().collect())) == sorted(map(str, expected.collect()))
    state = kept.log.latest()[1]
    assert state["base"]["rows"] and state["recent"]["rows"]
    kept.add(spark.createDataFrame([], ATTEMPT))
    assert kept.read().count() == expected.count()


def test_a_second_load_moves_nothing_of_the_base(spark):
    keyed = [a for a in attempts(1, 600) if a[0] and a[1]]
    place = folder(spark)
    kept = KeptResults(spark, place, ["at"], buckets=4, fold=10.0)
    kept.add(spark.createDataFrame(keyed[:400], ATTEMPT))
    kept.compact()
    kept.add(spark.createDataFrame(keyed[400:], ATTEMPT))
    for reader in (kept, KeptResults(spark, place, ["at"], buckets=4)):
        read = plan(reader.read())
        assert "SortMergeJoin" in read and "Exchange" not in read and "Sort [" not in read and read.count("Bucketed: true") == 2
    # counts by run shuffle sums, not rows
    summed = plan(kept.read().groupBy("run_id").agg(F.count("*")))
    assert summed.index("Exchange") < summed.index("partial_count") < summed.index("SortMergeJoin") and summed.count("Exchange") == 1
    # few columns asked, few columns read
    assert "ReadSchema: struct<run_id:string,task_id:string,at:int>" in plan(kept.read().select("run_id", "task_id", "at"))


def test_another_session_reads_the_kept_table(spark):
    place = folder(spark)
    KeptResults(spark, place, ["at"], buckets=2).add(spark.createDataFrame(attempts(3), ATTEMPT))
    other = spark.newSession()
    name = SnapshotLog(spark, place).latest()[1]["base"]["name"]
    spark.sql(f"drop table {name}")  # as in a session of another day
    kept = KeptResults(other, place, ["at"], buckets=2)
    assert kept.read().count() == latest_per_task(spark.createDataFrame(attempts(3), ATTEMPT), ["at"]).count()
    with pytest.raises(ValueError):
        KeptResults(spark, place, ["at"], buckets=3).add(spark.createDataFrame(attempts(4), ATTEMPT))


def test_changes_fold_into_the_base_and_old_files_go(spark):
    kept = KeptResults(spark, folder(spark), ["at"], buckets=2, fold=0.0)
    for load in range(3):
        kept.add(spark.createDataFrame(attempts(load, 60), ATTEMPT))
        assert kept.log.latest()[1]["recent"] is None
    before = kept.read().count()
    assert kept.forget(1) and kept.log.versions() == [3] and kept.read().count() == before


def test_writers_never_take_one_version(spark):
    log = SnapshotLog(spark, folder(spark))
    won, start = [], threading.Barrier(6)

    def write(i):
        start.wait()
        won.append((log.commit(1, {"writer": i}), i))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert sorted(ok for ok, _ in won) == [False] * 5 + [True]
    assert log.latest() == (1, {"writer": next(i for ok, i in won if ok)})


def test_two_loads_at_once_are_both_kept(spark):
    place = folder(spark)
    loads = [attempts(7, 100), attempts(8, 100)]
    threads = [threading.Thread(target=lambda load=load: KeptResults(spark, place, ["at"], buckets=2).add(spark.createDataFrame(load, ATTEMPT))) for load in loads]
    [x.start() for x in threads]
    [x.join() for x in threads]
    expected = latest_per_task(spark.createDataFrame(loads[0] + loads[1], ATTEMPT), ["at"])
    kept = KeptResults(spark, place, ["at"], buckets=2)
    assert sorted(map(str, kept.read().collect())) == sorted(map(str, expected.collect())) and kept.log.versions() == [1, 2]


def test_a_beaten_writer_tries_again(spark):
    log = SnapshotLog(spark, folder(spark))
    calls = []

    def change(state):
        calls.append(state)
        if len(calls) == 1:
            assert log.commit(1, {"n": 10})  # somebody else is faster
        return {"n": state.get("n", 0) + 1}

    assert log.update(change) == 2 and log.latest()[1] == {"n": 11} and calls == [{}, {"n": 10}]


def test_versions_of_an_output_are_not_shared(spark):
    path, made = folder(spark), []
    threads = [threading.Thread(target=lambda i=i: made.append(writers.write(spark.range(i + 1), path, keep_previous=True))) for i in range(4)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert sorted(p.rsplit("=", 1)[1] for p in made) == ["1", "2", "3", "4"]
    assert rows(spark.read.parquet(path).groupBy("version").count(), "count") == [(1,), (2,), (3,), (4,)]


RUN = "run_id int, workflow_name string, status string, start_time timestamp, end_time timestamp, duration_ms long, total_tasks long"
TASK = "run_id int, task_type string, status string, start_time timestamp, end_time timestamp, duration_ms long, retry_count int"


def facts(spark, n=120):
    rnd = random.Random(4)
    when = lambda: f"2024-01-0{rnd.randrange(1, 4)} 0{rnd.randrange(10)}:{rnd.randrange(10, 60)}:00"
    state = lambda: rnd.choice(("success", "failed", "partial_success", "skipped", "cancelled", "timeout", "running"))
    maybe = lambda x: None if rnd.random() < 0.2 else x
    runs = [(i, maybe(f"w{i % 4}"), state(), when(), maybe(when()), maybe(rnd.randrange(9000)), rnd.randrange(5)) for i in range(n)]
    tasks = [(i, maybe(f"k{k}"), state(), when(), maybe(when()), maybe(rnd.randrange(900)), maybe(k)) for i in range(n) for k in range(3)]

    def frame(rows, ddl):
        times = {"start_time": F.col("start_time").cast("timestamp"), "end_time": F.col("end_time").cast("timestamp")}
        return spark.createDataFrame(rows, ddl.replace("timestamp", "string")).withColumns(times)

    return frame(runs, RUN), frame(tasks, TASK)


def test_totals_of_loads_equal_the_batch(spark):
    runs, tasks = facts(spark)
    kept = totals.StoredTotals(spark, folder(spark), fold=2)
    for load in range(4):
        mine = F.col("run_id") % 4 == load
        assert kept.add(f"day {load}", runs.filter(mine), tasks.filter(mine))
    assert not kept.add("day 2", runs, tasks)
    stored = kept.rows()
    assert len(kept.log.latest()[1]["parts"]) == 2
    same = lambda a, b: rows(a, *sorted(a.columns)) and sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))
    assert same(totals.running_totals(stored), metrics.running_totals(runs, tasks))
    start, end = F.lit("2024-01-01 03:00:00").cast("timestamp"), F.lit("2024-01-03 00:00:00").cast("timestamp")
    assert same(totals.execution_metrics(stored, start, end), metrics.execution_metrics(runs, tasks, start, end))
    assert same(totals.period_series(stored, "daily"), metrics.period_series(runs, tasks, "daily"))


def test_breakdown_of_loads_equals_the_batch(spark):
    runs, tasks = facts(spark)
    runs, tasks = runs.fillna("w", ["workflow_name"]), tasks.fillna("k", ["task_type"])
    kept = totals.StoredTotals(spark, folder(spark))
    for load in range(2):
        mine = F.col("run_id") % 2 == load
        kept.add(f"{load}", runs.filter(mine), tasks.filter(mine))
    a, b = totals.breakdown(kept.rows()), metrics.breakdown(runs, tasks)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_totals_read_stored_rows_alone(spark):
    runs, tasks = facts(spark)
    kept = totals.StoredTotals(spark, folder(spark))
    kept.add("a", runs, tasks)
    read = plan(totals.running_totals(kept.rows()))
    assert read.count("FileScan") == 1 and "data-" in read and "LocalTableScan" not in read
    assert totals.running_totals(totals.StoredTotals(spark, folder(spark)).rows()).first().total_tasks == 0
