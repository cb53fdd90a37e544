import glob
import os
import random

import pytest
from frames import rows
from pyspark.sql import functions as F

from runmetrics.operators import dag, small_graphs, validation
from runmetrics.plans import tables
from runmetrics.session import RUNTIME_CONF, shared_dir


def _mixed(spark, kind="string"):
    """Graphs with repeated rows, null keys and tasks, loops, unknown ends; the last is larger than small ones are."""
    rnd = random.Random(3)
    name = (lambda i: f"t{i:02d}") if kind == "string" else (lambda i: i)
    nodes, edges, pairs = [], [], []
    for w, (size, links) in enumerate([(1, 0), (2, 3), (5, 6), (7, 11), (12, 14), (20, 30), (60, 70)]):
        tasks = [name(i) for i in range(size)]
        nodes += [(w, x) for x in tasks]
        edges += sorted({(w, rnd.choice(tasks), rnd.choice(tasks)) for _ in range(links)}, key=str)
        pairs += [(w, rnd.choice(tasks), rnd.choice(tasks)) for _ in range(12)]
    a, b, z = name(0), name(1), name(99)
    nodes += [(3, a), (2, None), (None, a), (20, a), (20, b)]
    edges += [(None, a, b), (3, z, a), (3, b, z), (3, None, a), (20, a, b), (20, b, a)]
    pairs += [(None, a, b), (3, None, a), (3, a, None), (3, z, a), (3, z, z), (77, a, b), (3, b, z), (3, b, z)]
    frame = lambda data, *columns: spark.createDataFrame(data, ", ".join(["workflow int", *(f"{c} {kind}" for c in columns)]))
    return frame(nodes, "task"), frame(edges, "src", "dst"), frame(pairs, "task", "other")


def _found(n, e, p):
    text = lambda df: sorted(map(str, df.collect()))
    graphs = small_graphs.Graphs("workflow", n, e)
    return [text(df) for df in (
        dag.dag_levels(n, e), dag.dag_cycles(n, e), dag.dag_unreachable(n, e), dag.has_dependency_path(e, p), dag.has_dependency_path(e, p.withColumn("note", F.lit("x"))),
        dag.unknown_dependencies(n, e, graphs=graphs), dag.workflows_without_root(n, e, graphs=graphs))]


@pytest.mark.parametrize("kind", ["string", "int"])
def test_small_graphs_are_solved_as_large_ones(spark, monkeypatch, kind):
    frames = _mixed(spark, kind)
    apart = _found(*frames)
    monkeypatch.setattr(small_graphs, "SMALL", 0)
    for mine, other in zip(apart, _found(*frames)):
        assert mine == other and mine


def test_small_graphs_take_no_rounds(spark):
    folders = lambda: {p for name in ("rounds", "contraction", "steps", "open") for p in glob.glob(f"{shared_dir(spark)}/{name}-*")}
    n, e, p = (df.filter("workflow < 6") for df in _mixed(spark))
    before = folders()
    _found(n, e, p)
    assert folders() == before


def test_messages_of_ordinary_workflows_are_not_numbered(spark):
    issues = spark.createDataFrame([(w, "t", i, "error", "k", f"m{i}") for w in ("a", "b", None) for i in range(3)],
                                   "workflow string, task string, ordinal int, severity string, kind string, message string")
    points = lambda: set(glob.glob(f"{shared_dir(spark)}/points-*"))
    before = points()
    pages = validation.validation_messages(issues).collect()
    assert points() == before
    assert sorted((str(r.workflow), r.page, r.errors, r.warnings) for r in pages) == [(w, 0, ["m0", "m1", "m2"], []) for w in ("None", "a", "b")]
    several = validation.validation_messages(issues.unionByName(issues.filter("workflow is null")), per_page=3).collect()
    assert sorted((str(r.workflow), r.page, len(r.errors)) for r in several) == [("None", 0, 3), ("None", 1, 3), ("a", 0, 3), ("b", 0, 3)]


def test_edges_of_odd_numbers_take_one_shuffle(spark, tmp_path):
    lines = [(1, 1), (1, 2), (1, 2), (1, 3), (1, 6), (2, 2), (2, 5), (3, None), (3, 4), (None, 1), (None, 2), (None, 2), (4, -1), (4, 0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = tables.edges(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [(1, 1, 2), (1, 2, 3), (1, 1, 3), (1, 3, 6), (2, 2, 5), (None, 1, 2), (4, -1, 0)], key=str)
    assert found._jdf.queryExecution().sparkPlan().toString().count("Window") == 2
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange") == 1


def test_tasks_get_few_megabytes_of_a_shuffle(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "orders.parquet"))
    tables.load(spark, str(tmp_path), "orders")
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    assert spark.conf.get(key) == RUNTIME_CONF[key] == "8m"
