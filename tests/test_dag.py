import functools
import os
import random

import pytest
from frames import rows
from pyspark.sql import functions as F

from runmetrics.operators import cycles, dag, validation
from runmetrics.plans import tables
from runmetrics.plans.catalog import QUERIES


def _graph(spark, nodes, edges, workflow="w"):
    n = spark.createDataFrame([(workflow, x) for x in nodes], "workflow string, task string")
    e = spark.createDataFrame([(workflow, a, b) for a, b in edges], "workflow string, src string, dst string")
    return n, e


DIAMOND = ("abcd", [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])


def test_diamond(spark):
    n, e = _graph(spark, *DIAMOND)
    levels = dag.dag_levels(n, e)
    assert dict(rows(levels, "task", "lvl")) == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert rows(dag.dag_shape(levels), "max_parallelism", "depth", "tasks") == [(2, 3, 4)]
    assert rows(dag.dag_roots(n, e), "task") == [("a",)] and rows(dag.dag_leaves(n, e), "task") == [("d",)]
    assert dag.dag_cycles(n, e).count() == 0
    target = n.filter("task = 'b'")
    assert rows(dag.dag_before(levels, target), "task") == [("a",)] and rows(dag.dag_after(levels, target), "task") == [("d",)]
    counts = {r.task: (r.tasks_before, r.tasks_after) for r in dag.dag_order_counts(levels).collect()}
    assert counts == {"a": (0, 3), "b": (1, 1), "c": (1, 1), "d": (3, 0)}
    pairs = spark.createDataFrame([("w", "d", "a"), ("w", "a", "d"), ("w", "c", "b"), ("w", "b", "b")], "workflow string, task string, other string")
    got = {(r.task, r.other): r.depends for r in dag.has_dependency_path(e, pairs).collect()}
    assert got == {("d", "a"): True, ("a", "d"): False, ("c", "b"): False, ("b", "b"): True}


def test_cycles(spark):
    n, e = _graph(spark, "abxyzr", [("a", "b"), ("b", "a"), ("b", "x"), ("x", "y"), ("y", "z"), ("z", "y"), ("r", "a")])
    assert rows(dag.dag_cycles(n, e), "task") == [("a",), ("b",), ("y",), ("z",)]
    levels = dict(rows(dag.dag_levels(n, e).fillna(-1, "lvl"), "task", "lvl"))
    assert levels == {"r": 0, "a": -1, "b": -1, "x": -1, "y": -1, "z": -1}
    n, e = _graph(spark, "abc", [("a", "b"), ("b", "a"), ("b", "c")])
    assert rows(dag.dag_cycles(n, e), "task") == [("a",), ("b",)]
    assert rows(dag.workflows_without_root(n, e)) == [("w",)]


def test_unreachable_needs_a_root(spark):
    n, e = _graph(spark, "rabu", [("a", "b"), ("b", "a"), ("missing", "u")])
    assert rows(dag.dag_unreachable(n, e), "task") == [("a",), ("b",), ("u",)]
    assert rows(dag.unknown_dependencies(n, e), "task", "dependency") == [("u", "missing")]
    n, e = _graph(spark, "ab", [("a", "b"), ("b", "a")])
    assert dag.dag_unreachable(n, e).count() == 0


def test_levels_of_a_hot_workflow_match_brute_force(spark):
    rnd = random.Random(5)
    names = [f"t{i:03d}" for i in range(150)]
    edges = sorted({(names[rnd.randrange(i)], names[i]) for i in range(1, 150) for _ in range(2)})
    level = {}
    for name in names:
        level[name] = max([level[a] + 1 for a, b in edges if b == name], default=0)
    n, e = _graph(spark, names, edges)
    assert dict(rows(dag.dag_levels(n, e), "task", "lvl")) == level


def test_skip_propagation_skips_the_whole_later_level(spark):
    levels = spark.createDataFrame([("r", t, l) for t, l in (("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 2))], "run_id string, task string, lvl int")
    tasks = spark.createDataFrame([("r", "wf", t, "failed" if t == "b" else "success") for t in "abcde"], "run_id string, workflow_name string, task_id string, status string")
    defs = spark.createDataFrame([("wf", t, True) for t in "abcde"], "workflow_name string, task_id string, required boolean")
    assert rows(dag.skip_propagation(levels, tasks, defs), "task_id", "status") == [
        ("a", "success"), ("b", "failed"), ("c", "success"), ("d", "skipped"), ("e", "skipped")]


def _lines(spark, folder, runs=700):
    """Task numbers of many runs, with gaps and repeats; returns the distinct ones of each."""
    rnd = random.Random(3)
    lines = [(run, rnd.randint(1, 9)) for run in range(runs) for _ in range(7)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int").write.parquet(f"{folder}/lineitem.parquet")
    numbers = {}
    for run, number in lines:
        numbers.setdefault(run, set()).add(number)
    return numbers


def _edges_of(numbers):
    return {(run, src, n) for run, have in numbers.items() for n in have
            for src in (max((m for m in have if m < n), default=None), n // 2) if src in have and src != n}


def _most_in_a_task(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_dependents_are_found_by_more_tasks_where_there_are_more_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 100, raising=False)
    expected = _edges_of(_lines(spark, tmp_path))
    for direction in ("dependents", "dependencies"):
        found = QUERIES[f"G4_{direction}"](spark, str(tmp_path))
        assert sorted(map(tuple, found.collect())) == sorted((r, a, b) if direction == "dependents" else (r, b, a) for r, a, b in expected)
        assert _most_in_a_task(found) < len(expected) / 10


@pytest.mark.parametrize("name, end", [("G6_leaves", 1), ("G6_roots", 2)])
def test_ends_of_runs_are_found_by_more_tasks_where_there_are_more_rows(spark, tmp_path, monkeypatch, name, end):
    monkeypatch.setattr(tables, "TASK_ROWS", 100, raising=False)
    numbers = _lines(spark, tmp_path)
    inner = {(edge[0], edge[end]) for edge in _edges_of(numbers)}
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")
    try:
        found = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, found.collect())) == sorted((r, n) for r, have in numbers.items() for n in have if (r, n) not in inner)
        assert _most_in_a_task(found) < len(numbers) / 10
    finally:
        spark.conf.unset(threshold)


@pytest.mark.parametrize("name", ["G6_leaves", "G6_roots"])
def test_ends_of_runs_are_found_without_sending_all_edges_to_each_task(spark, tmp_path, name):
    _lines(spark, tmp_path)
    assert "Broadcast" not in QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()


def test_ends_keep_repeated_tasks_and_those_without_a_key(spark):
    nodes = [("w", "a"), ("w", "a"), ("w", "b"), ("w", None), (None, "a"), (None, "b"), ("v", "b")]
    n = spark.createDataFrame(nodes, "workflow string, task string")
    e = spark.createDataFrame([("w", "a", "b"), ("w", "a", "b"), ("w", "c", "b"), (None, "a", "b"), ("w", "a", None)], "workflow string, src string, dst string")
    assert rows(dag.dag_roots(n, e).fillna("-")) == sorted((w or "-", t or "-") for w, t in nodes if (w, t) != ("w", "b"))
    assert rows(dag.dag_leaves(n, e).fillna("-")) == sorted((w or "-", t or "-") for w, t in nodes if (w, t) != ("w", "a"))


DEFINED = ("workflow string, task string, ordinal int, name string, task_type string, depends_on array<string>, max_attempts int, "
           "backoff_multiplier double, when string, config string")


def test_definition_checks(spark):
    defs = spark.createDataFrame([
        ("good", "a", 0, None, "command", [], None, None, None, "{}"), ("good", "b", 1, None, "command", ["a"], 3, 2.0, "{{ x }}", "{}"),
        ("bad", "a", 0, "same", "command", ["b"], 0, 2.0, None, "{}"), ("bad", "b", 1, "same", "magic", ["a"], 1, 2.0, None, "{}"),
        ("bad", "c", 2, None, "command", ["nonexistent_task"], 1, -1.0, "{{ x", "{}"), ("bad", "d", 3, None, "command", ["d"], None, None, None, None),
    ], DEFINED)
    flows = spark.createDataFrame([("good", "good", "file:///x"), ("bad", "bad", "ftp://x"), ("none", "none", "s3://b/x")],
                                  "workflow string, workflow_name string, output_destination string")
    issues = validation.definition_issues(flows, defs)
    found = {}
    for r in issues.collect():
        found.setdefault(r.workflow, []).append((r.kind, r.task))
    assert sorted(found["bad"], key=str) == sorted([
        ("config", "a"), ("task_type", "b"), ("config", "c"), ("config", "d"), ("template", "c"), ("unknown_dependency", "c"), ("cycle", "a"),
        ("cycle", "b"), ("cycle", "d"), ("self_dependency", "d"), ("duplicate", None), ("output", None), ("no_root", None)], key=str)
    assert found["none"] == [("empty", None)] and "good" not in found
    assert rows(validation.validate_definitions(flows, issues), "workflow", "is_valid") == [("bad", False), ("good", True), ("none", False)]
    pages = validation.validation_messages(issues, per_page=2)
    assert sum(len(r.errors) + len(r.warnings) for r in pages.collect()) == issues.count()
    assert sorted(len(r.errors) + len(r.warnings) for r in pages.filter("workflow = 'bad'").collect()) == [1, 2, 2, 2, 2, 2, 2]


def test_findings_of_one_task_fill_several_pages(spark):
    issues = spark.range(5000).select(F.lit("w").alias("workflow"), F.lit("t").alias("task"), F.lit(0).alias("ordinal"), F.lit("error").alias("severity"),
                                      F.lit("unknown_dependency").alias("kind"), F.col("id").cast("string").alias("message"))
    pages = validation.validation_messages(issues).collect()
    assert sorted((r.page, len(r.errors)) for r in pages) == [(i, 1000) for i in range(5)]
    assert len({m for r in pages for m in r.errors}) == 5000


def test_declared_definitions_hold_every_mistake(spark):
    defs = tables.declared_tasks(spark, "/root/testdata/sf0.001")
    kinds = {r.kind for r in validation.config_issues(defs).select("kind").distinct().collect()}
    assert kinds == {"config", "task_type", "template"}
    assert defs.filter(F.size("depends_on") == 0).count() > 0


def test_cycles_equal_brute_force(spark):
    rnd = random.Random(9)
    expected, frames = [], []
    for size, links in ((12, 14), (30, 40), (60, 75)):
        names = [f"t{i:03d}" for i in range(size)]
        edges = sorted({(rnd.choice(names), rnd.choice(names)) for _ in range(links)})
        reach = {a: {b for x, b in edges if x == a} for a in names}
        for _ in names:
            reach = {a: found.union(*(reach[b] for b in found)) if found else found for a, found in reach.items()}
        frames.append(_graph(spark, names, edges, f"w{size}"))
        expected += [(f"w{size}", a) for a in names if a in reach[a]]
    n, e = (functools.reduce(lambda x, y: x.unionByName(y), side) for side in zip(*frames))
    assert rows(dag.dag_cycles(n, e), "workflow", "task") == sorted(expected)


def test_reached_tasks_equal_brute_force(spark):
    rnd = random.Random(4)
    expected, frames, starts = [], [], []
    for size, links in ((12, 10), (30, 40), (60, 75), (40, 39)):
        names, w = [f"t{i:03d}" for i in range(size)], f"w{size}"
        edges = sorted({(rnd.choice(names), rnd.choice(names)) for _ in range(links)}) if links != 39 else list(zip(names, names[1:]))
        roots = rnd.sample(names, 2) if links != 39 else names[:1]
        found = set(roots)
        for _ in names:
            found |= {b for a, b in edges if a in found}
        frames.append(_graph(spark, names, edges, w))
        starts += [(w, r) for r in roots]
        expected += [(w, t) for t in found]
    e = functools.reduce(lambda x, y: x.unionByName(y), [f[1] for f in frames])
    sources = spark.createDataFrame(starts, "workflow string, task string")
    assert rows(dag.dag_reach(e, sources), "workflow", "task") == sorted(expected)


def test_reach_reads_what_is_open(spark):
    names = [f"t{i:03d}" for i in range(200)]
    _, e = _graph(spark, names, [*zip(names, names[1:]), ("t150", "t020"), ("lost", "t199"), ("lost", "found")])
    seen = []
    sources = spark.createDataFrame([("w", "t000")], "workflow string, task string")
    assert cycles.reached(e, sources, on_round=lambda number, size: seen.append(size)).count() == 200
    assert len(seen) <= 30 and sum(seen) <= 4 * len(names)


def plain_components(names, edges):
    reach = {a: {b for x, b in edges if x == a} for a in names}
    for _ in names:
        reach = {a: found.union(*(reach[b] for b in found)) if found else found for a, found in reach.items()}
    return sorted((a, min(b for b in names if b in reach[a] and a in reach[b])) for a in names if a in reach[a])


def test_components_equal_brute_force(spark):
    rnd = random.Random(2)
    graphs = []
    for size, links in ((10, 12), (25, 30), (25, 60), (40, 46), (30, 120)):
        names = [f"t{i:03d}" for i in range(size)]
        graphs.append((names, sorted({(rnd.choice(names), rnd.choice(names)) for _ in range(links)})))
    ring = [f"t{i:03d}" for i in range(30)]
    graphs.append((ring, [*zip(ring, ring[1:] + ring[:1]), ("t003", "t003"), ("t005", "t001")]))
    two = [*zip(ring[:9], ring[1:9] + ring[:1]), *zip(ring[20:], ring[21:] + ring[20:21]), *zip(ring[8:20], ring[9:21])]
    graphs.append((ring, two))
    dense = [f"t{i:03d}" for i in range(16)]  # every task has several of both, between two knots that don't lead back
    knots = [(a, b) for part in (dense[:5], dense[5:10], dense[10:]) for a in part for b in part if a != b]
    graphs.append((dense, sorted({*knots, *((a, b) for a in dense[:5] for b in dense[5:7]), *((a, b) for a in dense[7:10] for b in dense[10:12])})))
    parts = [_graph(spark, names, edges, f"w{i}") for i, (names, edges) in enumerate(graphs)]
    n, e = parts[0]
    for more_n, more_e in parts[1:]:
        n, e = n.unionByName(more_n), e.unionByName(more_e)
    found = rows(dag.dag_cycles(n, e), "workflow", "task", "component")
    assert found == sorted((f"w{i}", *row) for i, (names, edges) in enumerate(graphs) for row in plain_components(names, edges))


def test_chains_and_rings_take_few_rounds_and_rows(spark):
    names = [f"t{i:03d}" for i in range(200)]
    chain = list(zip(names, names[1:]))
    for edges, cyclic in ((chain, 0), ([*chain, (names[-1], names[0])], 200)):
        seen = []
        _, e = _graph(spark, names, edges)
        found = cycles.components(e, on_round=lambda number, size, seen=seen: seen.append(size)).collect()
        assert len(found) == cyclic and {r.component for r in found} <= {"t000"}
        assert len(seen) <= 40 and sum(seen) <= 6 * len(names)


def _written(spark, name):
    from runmetrics.session import shared_dir
    import glob
    paths = sorted(glob.glob(f"{shared_dir(spark)}/{name}-*"), key=os.path.getmtime)
    return spark.read.parquet(paths[-1])


def test_rounds_write_each_task_once(spark):
    names = [f"t{i:03d}" for i in range(60)]
    n, e = _graph(spark, names, list(zip(names, names[1:])))
    assert rows(dag.dag_levels(n, e), "lvl") == [(i,) for i in range(60)]
    assert _written(spark, "rounds").count() == 60
    wide = spark.range(20000)
    n = wide.select(F.lit("w").alias("workflow"), F.col("id").cast("string").alias("task"))
    e = wide.filter("id > 0").select(F.lit("w").alias("workflow"), F.lit("0").alias("src"), F.col("id").cast("string").alias("dst"))
    assert rows(dag.dag_levels(n, e).groupBy("lvl").count()) == [(0, 1), (1, 19999)]
    assert _written(spark, "rounds").count() == 20000
    self_pairs = n.limit(20).withColumn("other", F.col("task"))
    assert dag.has_dependency_path(e, self_pairs).filter("depends").count() == 20
    assert _written(spark, "rounds").count() == 0
