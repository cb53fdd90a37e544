"""The split windows against plain ones, with one key holding most rows."""

import random
from collections import Counter

from frames import rows
from pyspark.sql import Window, functions as F

from runmetrics.functions.times import utc
from runmetrics.operators import integrity, routing, windows


def _skewed(spark, n=6000):
    rnd = random.Random(3)
    made = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(20)}", i, rnd.randrange(200_000), rnd.randrange(1, 4)) for i in range(n)]
    return spark.createDataFrame(made, "k string, id long, s long, v long")


def test_top_n_in_two_steps_equals_one(spark):
    df = _skewed(spark)
    order = [F.col("s").desc(), F.col("id")]
    plain = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(*order))).filter("r <= 1500").drop("r")
    assert rows(windows.top_n_per_key(df, ["k"], order, 1500)) == rows(plain)
    assert rows(windows.top_n_per_key(df, ["k"], order, 5)) == rows(plain.withColumn(
        "r", F.row_number().over(Window.partitionBy("k").orderBy(*order))).filter("r <= 5").drop("r"))


def test_running_sums_over_blocks(spark):
    points = _skewed(spark).groupBy("k", "s").agg(F.sum("v").alias("v"))
    plain = points.withColumn("run", F.sum("v").over(Window.partitionBy("k").orderBy("s")))
    split = windows.running_sums(points, ["k"], "s", {"run": "v"}, F.floor(F.col("s") / 1000))
    assert rows(split, "k", "s", "run") == rows(plain, "k", "s", "run")


def test_trailing_counts_equal_range_frames(spark):
    ticks = _skewed(spark).groupBy("k", "s").agg(F.sum("v").alias("v"))
    plain = ticks
    for span in (60, 3600, 86400):
        plain = plain.withColumn(f"last_{span}s", F.sum("v").over(Window.partitionBy("k").orderBy("s").rangeBetween(-(span - 1), 0)))
    names = ["k", "s", "last_60s", "last_3600s", "last_86400s"]
    assert rows(windows.trailing_counts(ticks, ["k"], "s", "v", [60, 3600, 86400]), *names) == rows(plain, *names)


def test_no_limits_allow_everything(spark):
    df = spark.range(3).select(F.lit("c").alias("channel"), F.timestamp_seconds("id").alias("generated_at"))
    assert routing.rate_limited(df, routing.RateLimits()).filter("allowed").count() == 3


def test_rotation_by_count_size_and_age(spark):
    files = spark.createDataFrame(
        [("d", f"f{i}", i * 10) for i in range(6)], "folder string, path string, length long"
    ).withColumn("modificationTime", F.timestamp_seconds(F.col("length") * 8640))
    out = integrity.rotation_plan(files, integrity.Rotation(max_size_bytes=40, max_age_days=4, max_files=4), utc("1970-01-06"))
    assert rows(out, "path", "too_large", "too_old", "too_many") == [
        ("f0", False, True, True), ("f1", False, False, True), ("f2", False, False, False), ("f3", False, False, False),
        ("f4", False, False, False), ("f5", True, False, False)]


def test_null_keys_and_times_are_kept(spark):
    import datetime as dt

    from runmetrics.operators import routing
    at = dt.datetime(2024, 1, 1)
    reports = spark.createDataFrame([(1, "a", at), (2, None, at), (3, None, at), (4, "a", None), (5, None, None)], "id int, channel string, generated_at timestamp")
    found = {r.id: (r.last_60s, r.allowed) for r in routing.rate_limited(reports, routing.RateLimits(per_minute=1)).collect()}
    assert found == {1: (1, True), 2: (2, False), 3: (2, False), 4: (None, None), 5: (None, None)}


def test_running_runs_trigger_nothing(spark):
    from runmetrics.operators import routing
    runs = spark.createDataFrame([(1, "wf", "running"), (2, "wf", "success"), (3, None, None)], "run_id int, workflow_name string, status string")
    found = routing.runs_triggering(runs, [routing.Route("all", trigger_on_workflow_completion=True)])
    assert sorted(r.run_id for r in found.collect()) == [2, 3]


def test_channels_have_limits_of_their_own(spark):
    rows_of = [(i, c, f"2024-01-01 00:00:{i:02d}") for c in ("mail", "chat", "log", None) for i in range(4)]
    reports = spark.createDataFrame(rows_of, "id int, channel string, generated_at string").withColumn("generated_at", F.col("generated_at").cast("timestamp"))
    own = {"chat": routing.RateLimits(per_hour=3), "log": routing.RateLimits()}
    found = routing.rate_limited(reports, routing.RateLimits(per_minute=1), per_key=own).filter("allowed").collect()
    assert Counter(r.channel for r in found) == {"mail": 1, None: 1, "chat": 3, "log": 4}
    untimed = reports.limit(1).withColumn("generated_at", F.lit(None).cast("timestamp"))
    assert routing.rate_limited(untimed, routing.RateLimits(per_minute=1), per_key=own).first().allowed is None
