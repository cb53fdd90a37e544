"""Dependency graphs of many workflows at once.

Nodes are rows (key, task), edges rows (key, src, dst) where dst depends on src. The
iterative operators run one Spark job per graph level and write what each round finds to
the shared folder, each task once or as often as it is told of a freed dependency. Their work is spread by (key, task), never by key alone, so a workflow
holding a third of all tasks is shared by all executors. They take workflows of more than a few dozen rows; those below
are solved whole, see ``small_graphs``. Nothing lists pairs of tasks of
a workflow: questions about pairs take the pairs, or one source task per row, as input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, Window, functions as F, types as T

from ..session import shared_dir, stored
from . import small_graphs
from .cycles import components, reached
from .results import critical_tasks


def dag_edges(definitions: DataFrame, key: str = "workflow", task: str = "task") -> DataFrame:
    """One row per declared dependency."""
    return definitions.select(
        key, F.explode("depends_on").alias("src"), F.col(task).alias("dst")
    ).distinct()


def known_edges(nodes: DataFrame, edges: DataFrame, key: str = "workflow") -> DataFrame:
    """Edges that start at a defined task."""
    src = nodes.select(key, F.col("task").alias("src"))
    return edges.join(src, [key, "src"], "left_semi").select(key, "src", "dst")


def unknown_dependencies(nodes: DataFrame, edges: DataFrame, key: str = "workflow", graphs: small_graphs.Graphs | None = None) -> DataFrame:
    """Dependencies that aren't defined; with ``graphs`` of the same rows, only large workflows take a join."""
    if graphs:
        found = graphs.solved(small_graphs.unknown, [T.StructField("task", edges.schema["dst"].dataType), T.StructField("dependency", edges.schema["src"].dataType)])
        found = found.unionByName(edges.filter(F.col(key).isNull()).select(key, F.col("dst").alias("task"), F.col("src").alias("dependency")))
        return found.unionByName(unknown_dependencies(graphs.large_only(nodes), graphs.large_only(edges), key)) if graphs.any_large else found
    src = nodes.select(key, F.col("task").alias("src"))
    return edges.join(src, [key, "src"], "left_anti").select(
        key, F.col("dst").alias("task"), F.col("src").alias("dependency")
    )


def self_dependencies(edges: DataFrame, key: str = "workflow") -> DataFrame:
    return edges.filter(F.col("src") == F.col("dst")).select(key, F.col("src").alias("task"))


class _Rounds:
    """The rounds of a loop, each written once to the shared folder and read together as one table.

    ``add`` writes the next round and returns how many of its rows fulfil ``counted``, from the same job.
    """

    def __init__(self, df: DataFrame, counted: str = "true"):
        self.spark, self.counted, self.last = df.sparkSession, counted, -1
        self.path = f"{shared_dir(self.spark).rstrip('/')}/rounds-{uuid.uuid4().hex}"
        self.schema = df.schema

    def add(self, df: DataFrame) -> int:
        self.last += 1
        seen = Observation()
        df.observe(seen, F.count_if(F.expr(self.counted)).alias("n")).write.parquet(f"{self.path}/round={self.last}")
        return seen.get["n"]

    def latest(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/round={self.last}")

    def all(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("round", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path)


def dag_levels(nodes: DataFrame, edges: DataFrame, key: str = "workflow") -> DataFrame:
    """Execution batch of every task, from 0; null for tasks on or behind a cycle."""
    graphs = small_graphs.Graphs(key, nodes, edges)
    found = graphs.solved(small_graphs.levels, [nodes.schema["task"], T.StructField("lvl", T.IntegerType())])
    found = found.unionByName(nodes.filter(F.col(key).isNull()).select(key, "task", F.lit(None).cast("int").alias("lvl")))
    return found.unionByName(_large_levels(graphs.large_only(nodes), graphs.large_only(edges), key)) if graphs.any_large else found


def _large_levels(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Levels by rounds.

    A round takes the tasks freed in the last one and tells their dependents. It writes the tasks it frees, which are
    those of the next level, and those it told whose other dependencies are open; all others aren't touched.
    """
    known = known_edges(nodes, edges, key).distinct()
    of_each = Window.partitionBy(key, "dst")
    step = stored(known.select(key, F.col("src").alias("task"), "dst", F.count("*").over(of_each).alias("need")), "steps")
    told = nodes.select(key, "task").distinct().join(step.select(key, F.col("dst").alias("task")), [key, "task"], "left_anti").select(
        key, "task", *[F.lit(0).cast("long").alias(c) for c in ("got", "need")], F.lit(True).alias("free"))
    rounds = _Rounds(told, "free")
    while rounds.add(told):
        last = rounds.latest()
        tells = last.filter("free").drop("need").join(step, [key, "task"]).select(key, F.col("dst").alias("task"), F.lit(1).cast("long").alias("got"), "need")
        sums = tells.unionByName(last.filter("not free").drop("free")).groupBy(key, "task").agg(F.sum("got").alias("got"), F.max("need").alias("need"))
        told = sums.withColumn("free", F.col("got") == F.col("need"))
    freed = rounds.all().filter("free").select(key, "task", F.col("round").alias("lvl"))
    return nodes.select(key, "task").join(freed, [key, "task"], "left")


def dag_cycles(nodes: DataFrame, edges: DataFrame, key: str = "workflow", graphs: small_graphs.Graphs | None = None) -> DataFrame:
    """Tasks on a cycle, those that lead to themselves, and the component each is in, named after its smallest task.

    Tasks between two cycles are on none. ``graphs`` are the same nodes and edges, where several operators share them.
    """
    graphs = graphs or small_graphs.Graphs(key, nodes, edges)
    task = edges.schema["src"].dataType
    found = graphs.solved(small_graphs.cyclic, [T.StructField(c, task) for c in ("task", "component")])
    if not graphs.any_large:
        return found
    nodes, edges = graphs.large_only(nodes), graphs.large_only(edges)
    return found.unionByName(components(known_edges(nodes, edges, key).distinct(), key))


def neighbours(edges: DataFrame, direction: str = "dependents", key: str = "workflow") -> DataFrame:
    """Direct dependents or dependencies, one row each: a hub task may have any number."""
    near, far = ("src", "dst") if direction == "dependents" else ("dst", "src")
    return edges.select(key, F.col(near).alias("task"), F.col(far).alias("neighbour")).distinct()


def neighbour_counts(nodes: DataFrame, edges: DataFrame, key: str = "workflow") -> DataFrame:
    """Number of direct dependencies and dependents of every defined task."""
    end = "struct<task:{0},i:int,o:int,known:int>".format(nodes.schema["task"].dataType.simpleString())
    ends = edges.select(key, "src", "dst").distinct().select(
        key,
        F.explode(
            F.array(
                F.struct("dst", F.lit(1), F.lit(0), F.lit(0)).cast(end),
                F.struct("src", F.lit(0), F.lit(1), F.lit(0)).cast(end),
            )
        ).alias("e"),
    ).select(key, "e.*")
    defined = nodes.select(key, "task", F.lit(0).alias("i"), F.lit(0).alias("o"), F.lit(1).alias("known"))
    counts = defined.unionByName(ends).groupBy(key, "task").agg(
        F.sum("i").alias("dependencies"), F.sum("o").alias("dependents"), F.max("known").alias("known")
    )
    return counts.filter("known = 1").drop("known")


def _without(nodes: DataFrame, edges: DataFrame, end: str, key: str) -> DataFrame:
    """Tasks that are at that end of no edge.

    Edges are several per row they come from, which Spark's guess of their size doesn't know, so they aren't to be broadcast.
    """
    return nodes.select(key, "task").join(edges.select(key, F.col(end).alias("task")).hint("merge"), [key, "task"], "left_anti")


def dag_roots(nodes: DataFrame, edges: DataFrame, key: str = "workflow") -> DataFrame:
    return _without(nodes, edges, "dst", key)


def dag_leaves(nodes: DataFrame, edges: DataFrame, key: str = "workflow") -> DataFrame:
    return _without(nodes, edges, "src", key)


def workflows_without_root(nodes: DataFrame, edges: DataFrame, key: str = "workflow", graphs: small_graphs.Graphs | None = None) -> DataFrame:
    """Workflows in which every task has a dependency; with ``graphs`` of the same rows, only large ones take joins."""
    if graphs:
        found = graphs.solved(small_graphs.rootless, []).unionByName(nodes.filter(F.col(key).isNull()).select(key).distinct())
        return found.unionByName(workflows_without_root(graphs.large_only(nodes), graphs.large_only(edges), key)) if graphs.any_large else found
    rooted = dag_roots(nodes, edges, key).select(key)
    return nodes.select(key).distinct().join(rooted, key, "left_anti")


def dag_reach(edges: DataFrame, sources: DataFrame, key: str = "workflow", label: str | None = None) -> DataFrame:
    """Every task reachable from the given source tasks, the sources included.

    ``sources`` has (key, task). With ``label`` it also has that column, and tasks are
    found for every label on its own.
    """
    if not label:
        return reached(edges, sources, key)
    return _reached(edges, sources.select(key, label, "task").distinct(), [key, label, "task"], key)


def _reached(edges: DataFrame, start: DataFrame, ids: list[str], key: str, still_open=lambda found, df: df) -> DataFrame:
    """Rows ``ids`` found from ``start`` along the edges; ``still_open`` keeps the rows that need to go on."""
    step = stored(edges.select(key, F.col("src").alias("task"), "dst").distinct(), "steps")
    rounds = _Rounds(start)
    more = rounds.add(start)
    while more:
        found = rounds.all().drop("round")
        onward = still_open(found, rounds.latest()).join(step, [key, "task"]).select(*ids[:-1], F.col("dst").alias("task")).distinct()
        more = rounds.add(onward.join(found, ids, "left_anti"))
    return rounds.all().drop("round")


def has_dependency_path(edges: DataFrame, pairs: DataFrame, key: str = "workflow") -> DataFrame:
    """For rows (key, task, other): does ``task`` depend on ``other``, directly or not?

    A task counts as depending on itself. In large workflows the search starts at each ``other`` and goes on only while
    some task asked for it isn't found, so pairs that are answered soon cost little.
    """
    graphs = small_graphs.Graphs(key, None, edges, pairs)
    found = graphs.solved(small_graphs.depending, [pairs.schema["task"], pairs.schema["other"], graphs.rows.schema["rest"], T.StructField("__hit", T.BooleanType())])
    apart = found.select(key, "task", "other", "rest.*", "__hit").select(*pairs.columns, "__hit")
    apart = apart.unionByName(pairs.filter(F.col(key).isNull()).withColumn("__hit", F.lit(False)))
    answered = apart.select(*pairs.columns, (F.col("__hit") | (F.col("task") == F.col("other"))).alias("depends"))
    return answered.unionByName(_large_paths(graphs.large_only(edges), graphs.large_only(pairs), key)) if graphs.any_large else answered


def _large_paths(edges: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    asked = stored(pairs.select(key, "task", F.col("other").alias("origin")).distinct(), "pairs")
    start = asked.filter(F.col("task") != F.col("origin")).select(key, "origin", F.col("origin").alias("task")).distinct()

    def still_open(found: DataFrame, frontier: DataFrame) -> DataFrame:
        unanswered = asked.filter(F.col("task") != F.col("origin")).join(found, [key, "origin", "task"], "left_anti").select(key, "origin").distinct()
        return frontier.join(unanswered, [key, "origin"], "left_semi")

    hits = _reached(edges, start, [key, "origin", "task"], key, still_open).select(
        key, "task", F.col("origin").alias("other"), F.lit(True).alias("__hit"))
    return pairs.join(hits, [key, "task", "other"], "left").select(
        *pairs.columns, (F.coalesce("__hit", F.lit(False)) | (F.col("task") == F.col("other"))).alias("depends"))


def dag_unreachable(nodes: DataFrame, edges: DataFrame, key: str = "workflow", graphs: small_graphs.Graphs | None = None) -> DataFrame:
    """Tasks no root leads to, in workflows that have a root.

    A task with declared dependencies is no root, even when those are undefined.
    """
    graphs = graphs or small_graphs.Graphs(key, nodes, edges)
    found = graphs.solved(small_graphs.unreachable, [nodes.schema["task"]])
    if not graphs.any_large:
        return found
    nodes, edges = graphs.large_only(nodes), graphs.large_only(edges)
    roots = dag_roots(nodes, edges, key)
    rooted = roots.select(key).distinct()
    lost = nodes.select(key, "task").join(dag_reach(edges, roots, key), [key, "task"], "left_anti").join(rooted, key, "left_semi")
    return found.unionByName(lost)


def dag_shape(levels: DataFrame, key: str = "workflow") -> DataFrame:
    """Largest level, number of levels and number of tasks of every workflow."""
    per_level = levels.filter("lvl is not null").groupBy(key, "lvl").agg(F.count("*").alias("n"))
    return per_level.groupBy(key).agg(
        F.max("n").alias("max_parallelism"), (F.max("lvl") + 1).alias("depth"), F.sum("n").alias("tasks")
    )


def dag_before(levels: DataFrame, targets: DataFrame, key: str = "workflow") -> DataFrame:
    """Tasks in earlier levels than the target, for targets (key, task) of one task per workflow."""
    return _beside(levels, targets, key, lambda own, other: other < own)


def dag_after(levels: DataFrame, targets: DataFrame, key: str = "workflow") -> DataFrame:
    return _beside(levels, targets, key, lambda own, other: other > own)


def _beside(levels: DataFrame, targets: DataFrame, key: str, test) -> DataFrame:
    # One target per key keeps the result no larger than the task table.
    levels = stored(levels, "levels")
    single = targets.groupBy(key).agg(F.min("task").alias("task"), F.max("task").alias("__last"))
    checked = single.select(
        key,
        F.when(F.col("__last") == F.col("task"), F.col("task"))
        .otherwise(F.raise_error(F.lit("one target task per workflow expected")).cast("string"))
        .cast(levels.schema["task"].dataType)
        .alias("task"),
    )
    own = levels.join(checked, [key, "task"]).select(key, F.col("task").alias("target"), F.col("lvl").alias("__own"))
    return levels.join(own, key).filter(test(F.col("__own"), F.col("lvl"))).select(key, "target", "task", "lvl")


def dag_order_counts(levels: DataFrame, key: str = "workflow") -> DataFrame:
    """For every task, how many tasks run in earlier and in later levels."""
    per_level = levels.filter("lvl is not null").groupBy(key, "lvl").agg(F.count("*").alias("n"))
    by_level = Window.partitionBy(key).orderBy("lvl")
    counted = per_level.select(
        key, "lvl",
        F.coalesce(F.sum("n").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("tasks_before"),
        F.coalesce(F.sum("n").over(by_level.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("tasks_after"),
    )
    return levels.join(counted, [key, "lvl"]).select(key, "task", "lvl", "tasks_before", "tasks_after")


def skip_propagation(
    levels: DataFrame, tasks: DataFrame, definitions: DataFrame, key: str = "run_id",
    continue_on_error: bool | None = None,
) -> DataFrame:
    """Results after the stop rule: levels behind the first critical failure are skipped.

    ``levels`` has (key, task, lvl), ``tasks`` (key, workflow_name, task_id, status).
    """
    placed = stored(tasks.join(levels.withColumnRenamed("task", "task_id"), [key, "task_id"]), "placed")
    stop = critical_tasks(placed, definitions, continue_on_error).groupBy(key).agg(F.min("lvl").alias("stop_level"))
    behind = F.col("stop_level").isNotNull() & (F.col("lvl") > F.col("stop_level"))
    return placed.join(stop, key, "left").select(
        key, "task_id", "lvl", "stop_level", F.when(behind, "skipped").otherwise(F.col("status")).alias("status")
    )
