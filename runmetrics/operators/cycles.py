"""Strongly connected components of many dependency graphs at once, by contraction.

A task with a single predecessor u lies on a cycle only together with u, so it can be merged into u: its edges become
u's, and no cycle appears or goes. The same holds for a task with a single successor. Each round drops edges of tasks
that nothing leads to or that lead nowhere, and merges such tasks into neighbours that stay, in turn by predecessors and
by successors. Of tasks in a row those merge whose neighbour has a smaller random rank than they and its own neighbour
have: of a chain or a ring a third in the mean, of every ring at least one. So a ring takes as many rounds as the
logarithm of its length, and all rounds together write as many rows as a few of the first.

What is left when every task has several of both is told apart by labels: the ends of an edge on a cycle are led to, and
lead to, the same tasks. Then the rounds are unrolled: a task merged into u belongs to u's component if one of its other
neighbours does.

Ranks are hashes of round and task, so lost work comes out alike when it is done again. Tables are keyed by (key, task),
never by key alone, and every round is a written table.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..session import stored

ENDS = ("src", "dst")


def _rank(number: int, key: str, task: str) -> Column:
    return F.xxhash64(F.lit(number), F.col(key), F.col(task))


def merge_singles(held: DataFrame, key: str, number: int, by: str) -> DataFrame:
    """Edges and what becomes of them when tasks with one neighbour are merged into it.

    ``by`` is the end whose tasks are merged (dst: those with one predecessor). ``single``: the task at that end has one
    neighbour; ``gone``: it is merged along this edge; ``into``: the task that the other end is merged into.
    """
    other = "src" if by == "dst" else "dst"
    alone = held.groupBy(key, by).agg(F.count("*").alias("n"), F.min(other).alias("near")).filter("n = 1").select(key, F.col(by).alias("task"), "near")
    # the neighbour's neighbour, and whether that has a single neighbour, too
    second = alone.select(key, F.col("task").alias("near"), F.col("near").alias("far"))
    third = alone.select(key, F.col("task").alias("far"), F.lit(True).alias("farther"))
    rank = lambda task: _rank(number, key, task)
    stays = F.col("farther").isNotNull() & (rank("near") < rank("far")) & (rank("near") < rank("task"))
    merged = alone.join(second, [key, "near"], "left").join(third, [key, "far"], "left").select(
        key, F.col("task").alias("__task"), F.col("near").alias("__near"), (F.col("far").isNull() | F.coalesce(stays, F.lit(False))).alias("__merges"))
    here = merged.select(key, F.col("__task").alias(by), F.col("__merges"))
    there = merged.filter("__merges").select(key, F.col("__task").alias(other), F.col("__near").alias("into"))
    return held.join(here, [key, by], "left").join(there, [key, other], "left").select(
        key, "src", "dst", F.col("__merges").isNotNull().alias("single"), F.coalesce("__merges", F.lit(False)).alias("gone"), "into")


def _marked(edges: DataFrame, key: str, number: int, by: str) -> DataFrame:
    """Edges between tasks that have both kinds of neighbours, marked as by ``merge_singles``."""
    led = edges.select(key, F.col("dst").alias("src")).distinct()
    leading = edges.select(key, F.col("src").alias("dst")).distinct()
    held = edges.join(led, [key, "src"], "left_semi").join(leading, [key, "dst"], "left_semi")
    return merge_singles(held, key, number, by)


def contracted(marked: DataFrame, key: str, by: str) -> DataFrame:
    """The edges after the merges of a round."""
    other = "src" if by == "dst" else "dst"
    moved = marked.filter("not gone").withColumn(other, F.coalesce("into", other)).select(key, *ENDS)
    return moved.filter("src <> dst").distinct()


def _labels(edges: DataFrame, key: str) -> DataFrame:
    """For every task the smallest task that leads to it (``first``) and that it leads to (``last``), itself included."""
    ends = edges.select(key, F.explode(F.array(*ENDS)).alias("task")).distinct()
    labels = ends.select(key, "task", F.col("task").alias("first"), F.col("task").alias("last"), F.lit(True).alias("changed"))
    smaller = lambda c: F.coalesce(F.col(f"__{c}") < F.col(c), F.lit(False))
    while True:
        seen = Observation()
        own = stored(labels.observe(seen, F.count_if("changed").alias("n")), "labels")
        if not seen.get["n"]:
            return own.select(key, "task", "first", "last")
        moved = own.filter("changed")
        heard = None
        for label, start, end in (("first", "src", "dst"), ("last", "dst", "src")):
            told = moved.select(key, F.col("task").alias(start), label).join(edges, [key, start]).groupBy(key, F.col(end).alias("task")).agg(F.min(label).alias(f"__{label}"))
            heard = told if heard is None else heard.join(told, [key, "task"], "full_outer")
        labels = own.join(heard, [key, "task"], "left").select(
            key, "task", F.least("first", "__first").alias("first"), F.least("last", "__last").alias("last"), (smaller("first") | smaller("last")).alias("changed"))


def _split(edges: DataFrame, key: str) -> tuple[DataFrame, DataFrame, int]:
    """Edges within a label, the labels, and how many edges were dropped."""
    labels = _labels(edges, key)
    pair = F.struct("first", "last")
    start = labels.select(key, F.col("task").alias("src"), pair.alias("__from"))
    end = labels.select(key, F.col("task").alias("dst"), pair.alias("__to"))
    seen = Observation()
    same = F.col("__from") == F.col("__to")
    kept = edges.join(start, [key, "src"]).join(end, [key, "dst"]).observe(seen, F.count_if(~same).alias("n")).filter(same).select(key, *ENDS)
    kept = stored(kept, "within")
    return kept, labels, seen.get["n"]


def components(edges: DataFrame, key: str = "workflow", on_round: Callable[[int, int], object] | None = None) -> DataFrame:
    """(key, task, component) for the tasks on a cycle; the component is named after its smallest task.

    ``on_round`` is told the number of each round and the edges it wrote.
    """
    edges = edges.select(key, *ENDS)
    loops = edges.filter("src = dst").select(key, F.col("src").alias("task")).distinct()
    left, rounds, idle = edges.filter("src <> dst").distinct(), [], 0
    kind = edges.schema["src"].dataType
    named = edges.sparkSession.createDataFrame([], edges.select(key, F.col("src").alias("task"), F.col("src").alias("component")).schema)
    while True:
        number, by = len(rounds), ENDS[1 - len(rounds) % 2]
        seen = Observation()
        marked = stored(_marked(left, key, number, by).observe(
            seen, F.count("*").alias("edges"), F.count_if("single").alias("single"), F.count("into").alias("moved"), F.count_if(F.col("into") == F.col(by)).alias("closed")), "contraction")
        found = seen.get
        rounds.append((marked, by, found["moved"], found["closed"]))
        if on_round:
            on_round(number, found["edges"])
        if not found["edges"]:
            break
        left = contracted(marked, key, by)
        idle = 0 if found["single"] else idle + 1
        if idle == 2:
            left, labels, dropped = _split(marked.select(key, *ENDS), key)
            idle = 0
            if not dropped:
                named = labels.filter("task <> first").select(key, "task", F.col("first").alias("component"))
                break
    members = _unrolled(rounds, named, key)
    whole = members.unionByName(members.select(key, F.col("component").cast(kind).alias("task"), "component")).unionByName(
        loops.join(members, [key, "task"], "left_anti").select(key, "task", F.col("task").alias("component"))).distinct()
    # a task with a loop may also be the one that others were merged into
    names = whole.groupBy(key, "component").agg(F.min("task").alias("__name"))
    return whole.join(names, [key, "component"]).groupBy(key, "task").agg(F.min("__name").alias("component"))


def reached(edges: DataFrame, sources: DataFrame, key: str = "workflow", on_round: Callable[[int, int], object] | None = None) -> DataFrame:
    """(key, task) of the sources and of all tasks they lead to.

    A round takes the tasks that the last ones lead to, and drops their edges and those of tasks that nothing leads to
    any more. Of the rest, tasks with a single predecessor are merged into it: they are reached if it is. So each round
    reads what is still open only, and a chain takes as many rounds as the logarithm of its length.
    """
    new = stored(sources.select(key, "task").distinct(), "reached")
    open_ = edges.select(key, *ENDS).filter("src <> dst").distinct().join(new.select(key, F.col("task").alias("dst")), [key, "dst"], "left_anti").select(key, *ENDS)
    parts, merges, number = [new], [], 0
    while True:
        open_ = stored(open_, "open")
        seen = Observation()
        before = new
        new = stored(open_.join(before.select(key, F.col("task").alias("src")), [key, "src"], "left_semi").select(
            key, F.col("dst").alias("task")).distinct().observe(seen, F.count("*").alias("n")), "reached")
        if not seen.get["n"]:
            break
        parts.append(new)
        rest = open_.join(before.select(key, F.col("task").alias("src")), [key, "src"], "left_anti").join(
            new.select(key, F.col("task").alias("dst")), [key, "dst"], "left_anti")
        led = rest.select(key, F.col("dst").alias("src")).unionByName(new.select(key, F.col("task").alias("src"))).distinct()
        size = Observation()
        marked = stored(merge_singles(rest.join(led, [key, "src"], "left_semi"), key, number, "dst").observe(
            size, F.count("*").alias("edges"), F.count_if("gone").alias("gone")), "contraction")
        if size.get["gone"]:
            merges.append(marked.filter("gone").select(key, F.col("dst").alias("task"), F.col("src").alias("into")))
        if on_round:
            on_round(number, size.get["edges"])
        open_, number = contracted(marked, key, "dst"), number + 1
    for merged in reversed(merges):
        known = functools.reduce(DataFrame.unionByName, parts).select(key, F.col("task").alias("into"))
        parts.append(stored(merged.join(known, [key, "into"], "left_semi").select(key, "task"), "reached"))
    return functools.reduce(DataFrame.unionByName, parts)


def _unrolled(rounds: list[tuple[DataFrame, str, int, int]], named: DataFrame, key: str) -> DataFrame:
    """(key, task, component) of the tasks that are in the component of another task, from the last round to the first.

    Rounds have their edges, the end they merged by, and the numbers of edges moved and of those that closed a cycle.
    """
    parts = [stored(named, "components")]
    some = not parts[0].isEmpty()
    for marked, by, moved, closed in reversed(rounds):
        if not moved or not (some or closed):  # while no component is known, only a closed cycle makes one
            continue
        other = "src" if by == "dst" else "dst"
        known = functools.reduce(DataFrame.unionByName, parts)
        of = lambda task, name: known.select(key, F.col("task").alias(task), F.col("component").alias(name))
        asked = marked.filter("into is not null").select(key, F.col(other).alias("task"), "into", F.col(by).alias("near"))
        looked = asked.join(of("into", "__into"), [key, "into"], "left").join(of("near", "__near"), [key, "near"], "left")
        own = F.coalesce("__into", "into")
        found = looked.filter(F.coalesce("__near", "near") == own).select(key, "task", own.alias("component")).distinct()
        parts.append(stored(found, "components"))
        some = True
    return functools.reduce(DataFrame.unionByName, parts)
