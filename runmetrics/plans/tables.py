"""Run logs derived from the star schema tables, as the input of the catalog queries.

Orders become runs, line items become task attempts (a repeated task of a run is a later
attempt), and the line numbers of an order form its dependency graph.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.results import latest_per_task, run_facts
from ..session import configure, stored

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
              "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp",
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}

# Task numbers that one Spark task sorts or hashes, a few 64 MB pages of its memory. To over 200 parts (Spark's
# spark.shuffle.sort.bypassMergeThreshold) a scan sorts all it read before it writes, so there are more only for FULL_ROWS.
TASK_ROWS, FULL_ROWS, PARTS = 500_000, 2_000_000, 200


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table with its declared schema; times are read as UTC timestamps."""
    configure(spark)
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def _plus_minutes(day: Column, minutes: Column) -> Column:
    return day + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"), F.lit(0))


def task_attempts(spark: SparkSession, sf: str, typed: bool = True) -> DataFrame:
    """All attempts of all tasks. Only ``typed`` ones need the part table for their type."""
    c = F.col
    line = load(spark, sf, "lineitem")
    if typed:
        part = load(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("task_type"))
        line = line.join(part, "l_partkey")
    flag, state = c("l_returnflag"), c("l_linestatus")
    status = (
        F.when((flag == "N") | ((flag == "A") & (state == "F")), "success")
        .when(flag == "A", "skipped")
        .when(state == "F", "failed")
        .when(c("l_suppkey") % 2 == 0, "timeout")
        .otherwise("cancelled")
    )
    start = _plus_minutes(c("l_shipdate"), c("l_partkey") % 1440)
    duration = F.when(c("l_tax") != 0, F.round(c("l_quantity") * 1000).cast("long"))
    error = F.when(
        flag == "R",
        F.concat(F.lit("E"), (c("l_suppkey") % 5).cast("string"), F.lit(": part "), c("l_partkey").cast("string")),
    )
    return line.select(
        c("l_orderkey").alias("run_id"),
        F.concat(F.lit("task_"), c("l_linenumber").cast("string")).alias("task_id"),
        *(["task_type"] if typed else []),
        c("l_linenumber").alias("ordinal"),
        status.alias("status"), start.alias("start_time"),
        F.timestamp_millis(F.unix_millis(start) + duration).alias("end_time"), duration.alias("duration_ms"),
        F.round(c("l_tax") * 100).cast("int").alias("retry_count"), error.alias("error"),
        "l_partkey", "l_suppkey", "l_discount",
    )


def task_runs(spark: SparkSession, sf: str, typed: bool = True) -> DataFrame:
    return latest_per_task(task_attempts(spark, sf, typed), ["start_time", "l_partkey", "l_suppkey"])


def runs(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    started = _plus_minutes(c("o_orderdate"), c("o_orderkey") % 1440)
    ended = _plus_minutes(c("o_orderdate"), c("o_orderkey") % 1440 + c("o_custkey") % 90)
    open_run = c("o_orderstatus") == "P"
    return load(spark, sf, "orders").select(
        c("o_orderkey").alias("run_id"),
        F.concat(F.lit("wf_"), (c("o_custkey") % 50).cast("string")).alias("workflow_name"),
        started.alias("start_time"),
        F.when(~open_run, ended).alias("end_time"),
        F.when(~open_run, (c("o_custkey") % 90) * 60000).alias("duration_ms"),
        c("o_orderpriority").alias("priority"),
    )


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with status and counters from their tasks."""
    return run_facts(runs(spark, sf), task_runs(spark, sf, typed=False))


def facts_and_tasks(spark: SparkSession, sf: str, typed: bool = True) -> tuple[DataFrame, DataFrame]:
    """Run facts and task results from one upsert, as jobs have them: the results are stored once and read by both."""
    tasks = stored(task_runs(spark, sf, typed), "task-results")
    return run_facts(runs(spark, sf), tasks), tasks


def named_tasks(spark: SparkSession, sf: str, typed: bool = True) -> DataFrame:
    """Task results with the name of their workflow."""
    names = runs(spark, sf).select("run_id", "workflow_name")
    return task_runs(spark, sf, typed).join(names, "run_id")


def _numbers(spark: SparkSession, sf: str, *by: str) -> DataFrame:
    """Task numbers of all runs, repeats included, equal ones of ``by`` together.

    They are dealt to as many Spark tasks as there are rows for, and one a core at least: the session's number of shuffle
    partitions is the same for a table of any size, so each would grow with the table. The count takes file footers only.
    """
    line = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("task"))
    rows = line.count()
    parts = max(min(math.ceil(rows / TASK_ROWS), PARTS), math.ceil(rows / FULL_ROWS), spark.sparkContext.defaultParallelism)
    return line.repartition(parts, *by)


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _numbers(spark, sf, "run_id", "task").distinct()


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Every task depends on the one before it and on the one at half its number, if the run has it.

    The numbers of a run are brought together once. Sorted, equal ones are neighbours; each names itself and what it
    depends on, and sorted again, a number stands before the tasks that name it.
    """
    task = F.col("task")
    before = F.lag("task").over(Window.partitionBy("run_id").orderBy("task"))
    numbers = _numbers(spark, sf, "run_id").withColumn("before", before).filter("task is not null and (before is null or before <> task)")
    end = lambda src, dst: F.struct(src.cast("int").alias("src"), dst.cast("int").alias("dst"))
    half = F.floor(task / 2).cast("int")
    ends = F.array(
        end(task, F.lit(None)), F.when(F.col("before").isNotNull(), end(F.col("before"), task)),
        F.when((task > 1) & ~F.col("before").eqNullSafe(half) & F.col("run_id").isNotNull(), end(half, task)),
    )
    named = numbers.select("run_id", F.explode(ends).alias("e")).filter("e is not null").select("run_id", "e.src", "e.dst")
    so_far = Window.partitionBy("run_id", "src").orderBy(F.col("dst").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    known = F.max(F.col("dst").isNull()).over(so_far)
    return named.withColumn("known", known).filter("known and dst is not null").select("run_id", "src", "dst")


def workflow_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Definitions of the named workflows: seven tasks each."""
    n = F.col("n")
    names = runs(spark, sf).select("workflow_name").distinct()
    return names.select("workflow_name", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("n")).select(
        "workflow_name", n.alias("ordinal"), F.concat(F.lit("task_"), n.cast("string")).alias("task_id"),
        F.element_at(F.array(*[F.lit(t) for t in ("command", "compress", "checksum", "email", "slack", "template", "file")]), n).alias("task_type"),
        (n % 3 != 0).alias("required"),
        F.when(n % 4 != 0, n % 5).alias("max_attempts"),
        F.when(n % 4 != 0, (n * 250).cast("long")).alias("initial_delay_ms"),
        F.when(n % 4 != 0, F.lit(1.0) + n / F.lit(2.0)).alias("backoff_multiplier"),
        F.when(F.col("workflow_name").endswith("3"), False).when(F.col("workflow_name").endswith("4"), True).alias("continue_on_error"),
    )


def declared_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """One definition per task of every order, with all kinds of mistakes in it."""
    c, n = F.col, F.col("ordinal")

    def task(number: Column) -> Column:
        return F.concat(F.lit("task_"), number.cast("string"))

    # Only what the definitions take from a task goes on; its part has to be known, its type isn't asked for.
    parts = load(spark, sf, "part").select(c("p_partkey").alias("l_partkey"))
    attempts = task_attempts(spark, sf, typed=False).join(parts, "l_partkey", "left_semi").select(
        "run_id", "ordinal", "status", "start_time", "retry_count", c("error").isNotNull().alias("failed"), "l_partkey", "l_suppkey", "l_discount")
    # A thousand numbers of a run go one way: ordinary runs stay together, which packs well, and a very large one is spread.
    attempts = attempts.withColumn("block", F.floor(n / 1000)).repartition("run_id", "block")
    latest = latest_per_task(attempts, ["start_time", "l_partkey", "l_suppkey"], ["run_id", "block", "ordinal"]).select(
        "run_id", "ordinal", "status", "retry_count", "failed", "l_discount", F.when(c("l_suppkey") % 4 != 0, (c("l_partkey") % 9).cast("tinyint")).alias("job"))
    state = load(spark, sf, "orders").select(c("o_orderkey").alias("run_id"), "o_orderstatus")
    rows = latest.join(state, "run_id").withColumn("task_id", task(n))
    depends = F.array_distinct(
        F.array_compact(
            F.array(
                F.when(n > 1, task(n - 1)),
                F.when(n > 1, task(F.floor(n / 2))),
                F.when((n == 1) & (c("o_orderstatus") == "P"), F.lit("task_2")),
                F.when((c("l_discount") == 0) & c("failed"), c("task_id")),
            )
        )
    )
    when = (
        F.when(n == 3, "{{ env }}").when(n == 5, "{{ a {{ b }} }}").when(n == 6, "{ open").when(n == 7, "closed }")
    )
    return rows.select(
        c("run_id").alias("workflow"), c("task_id").alias("task"), "ordinal",
        F.concat(F.lit("job "), c("job").cast("string")).alias("name"),
        F.when(c("status") == "timeout", "decompress").otherwise("command").alias("task_type"),
        depends.alias("depends_on"),
        F.when(c("retry_count") < 8, c("retry_count")).alias("max_attempts"),
        F.round(c("l_discount") * 100).alias("backoff_multiplier"),
        when.alias("when"),
        F.when(c("status") != "skipped", c("status")).alias("config"),
    )


def declared_workflows(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("workflow"),
        F.when(F.col("o_custkey") % 50 != 0, F.concat(F.lit("wf_"), (F.col("o_custkey") % 50).cast("string")))
        .otherwise(" ").alias("workflow_name"),
        F.when(p == "1-URGENT", "s3://bucket/x").when(p == "2-HIGH", "file:///out/x").when(p == "3-MEDIUM", "s3:///x")
        .when(p == "4-NOT SPECIFIED", "ftp://host/x").when(F.col("o_orderstatus") == "F", " ").otherwise("no url")
        .alias("output_destination"),
    )


def nested_runs(spark: SparkSession, sf: str) -> DataFrame:
    return nested_runs_of(load(spark, sf, "orders"))


def nested_runs_of(orders: DataFrame) -> DataFrame:
    """Runs that carry their tasks as an array, made from the order row alone."""
    c = F.col
    statuses = F.array(*[F.lit(s) for s in ("success", "failed", "skipped", "timeout", "cancelled", "running")])
    base = orders.select(
        c("o_orderkey").alias("run_id"), "o_custkey", "o_orderpriority",
        _plus_minutes(c("o_orderdate"), c("o_orderkey") % 1440).alias("start_time"),
    )

    def one(i: Column) -> Column:
        ms = ((c("o_custkey") + i) % 60 * 1000).cast("long")
        return F.struct(
            F.concat(F.lit("task_"), i.cast("string")).alias("task_id"), c("o_orderpriority").alias("task_type"),
            F.element_at(statuses, ((c("o_custkey") + i) % 6 + 1).cast("int")).alias("status"),
            c("start_time").alias("start_time"),
            F.timestamp_millis(F.unix_millis("start_time") + ms).alias("end_time"), ms.alias("duration_ms"),
            F.concat(F.lit("output of task "), i.cast("string")).alias("output"),
            F.when((c("o_custkey") + i) % 6 == 1, F.lit("E1: failed")).alias("error"),
            (i % 3).cast("int").alias("retry_count"),
            F.create_map(F.lit("exit_code"), ((c("o_custkey") + i) % 4).cast("string")).alias("metadata"),
        )

    count = (c("o_custkey") % 5).cast("int")
    tasks = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), one)).otherwise(
        F.transform(F.array().cast("array<int>"), one)
    )
    return base.select(
        F.concat(F.lit("wf_"), (c("o_custkey") % 50).cast("string")).alias("workflow_name"), "run_id",
        F.element_at(F.array(*[F.lit(s) for s in ("success", "failed", "partial_success")]), (c("o_custkey") % 3 + 1).cast("int")).alias("status"),
        "start_time",
        F.timestamp_millis(F.unix_millis("start_time") + c("o_custkey") % 90 * 60000).alias("end_time"),
        (c("o_custkey") % 90 * 60000).cast("long").alias("duration_ms"),
        F.create_map(F.lit("priority"), c("o_orderpriority")).alias("metadata"),
        tasks.alias("tasks"),
    )
