"""Graphs of few rows, solved whole: one row per graph, many graphs at a time in arrays.

A loop over rounds reads and writes its tables once per level, for millions of workflows of a dozen tasks as for one of
millions. Here the nodes, edges and questions of a workflow that has at most ``SMALL`` of them are brought together by
one shuffle, and numpy solves the graphs of a batch together. Workflows with more rows are named in ``large``; they are
left to the operators that spread the tasks of a workflow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import stored

SMALL = 64  # rows of a graph
NODE, EDGE, PAIR = 0, 1, 2


class Graphs:
    """Rows (key, kind, task, src) of many graphs: nodes, edges src -> task, and pairs asked about; null keys are left out.

    Pairs carry their other columns in ``rest``.
    """

    def __init__(self, key: str, nodes: DataFrame | None, edges: DataFrame, pairs: DataFrame | None = None):
        self.key = key
        parts = [edges.select(key, F.lit(EDGE).alias("kind"), F.col("dst").alias("task"), "src")]
        if nodes is not None:
            parts.append(nodes.select(key, F.lit(NODE).alias("kind"), "task", F.lit(None).cast(edges.schema["src"].dataType).alias("src")))
        if pairs is not None:
            parts.append(pairs.select(key, F.lit(PAIR).alias("kind"), "task", F.col("other").alias("src"),
                                      F.struct(F.lit(True).alias("__asked"), *[c for c in pairs.columns if c not in (key, "task", "other")]).alias("rest")))
        rows = parts[-1]
        for part in parts[:-1]:
            rows = rows.unionByName(part, allowMissingColumns=True)
        self.rows = stored(rows.filter(F.col(key).isNotNull()), "graph-rows")
        self.large = stored(self.rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > SMALL).select(key), "large-graphs")
        self.any_large = not self.large.isEmpty()

    def large_only(self, df: DataFrame) -> DataFrame:
        return df.join(self.large, self.key, "left_semi")

    def solved(self, solve: Callable, fields: list[T.StructField]) -> DataFrame:
        """What ``solve`` finds in the graphs that aren't large: rows (key, then ``fields``)."""
        key = self.key
        # there is at most one large graph for every SMALL rows
        rows = self.rows.join(F.broadcast(self.large), key, "left_anti") if self.any_large else self.rows
        whole = rows.repartition(key).groupBy(key).agg(F.collect_list(F.struct(*[c for c in rows.columns if c != key])).alias("rows"))
        return whole.mapInArrow(_batches(solve), T.StructType([rows.schema[key], *fields]))


def _batches(solve: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield solve(_Batch(batch))

    return run


class _Batch:
    """The graphs of a batch: their vertices numbered by graph, then in the order of their tasks."""

    def __init__(self, batch: pa.RecordBatch):
        lists = batch.column(1)
        self.keys, rows = batch.column(0), lists.flatten()
        self.name = batch.schema.names[0]
        self.graph = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        self.kind = rows.field("kind").to_numpy(zero_copy_only=False)
        self.task, self.src = rows.field("task"), rows.field("src")
        self.rest = rows.field("rest") if rows.type.get_field_index("rest") >= 0 else None
        coded = pa.concat_arrays([self.task, self.src.cast(self.task.type)]).dictionary_encode()
        names = len(coded.dictionary)
        place = np.empty(names + 1, np.int64)
        place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(names)
        codes = place[coded.indices.fill_null(names).to_numpy(zero_copy_only=False)]
        here = coded.indices.is_valid().to_numpy(zero_copy_only=False)
        ids = np.tile(self.graph, 2) * (names + 1) + codes
        known, spots = np.unique(ids[here], return_inverse=True)
        vertex = np.full(len(ids), -1)
        vertex[here] = spots
        self.at, self.source = vertex[: len(rows)], vertex[len(rows):]  # -1: null
        self.count = len(known)
        self.owner = known // (names + 1)
        self.nodes = self.kind == NODE
        # the row that names each vertex, to give its task back
        self.named = np.empty(self.count, np.int64)
        self.named[spots] = np.flatnonzero(here)
        self.names = pa.concat_arrays([self.task, self.src.cast(self.task.type)])

    def edges(self, known: bool) -> tuple[np.ndarray, np.ndarray]:
        """Distinct edges by source; only those that start at a node, if ``known``."""
        kept = (self.kind == EDGE) & (self.at >= 0) & (self.source >= 0)
        if known:
            defined = self.marked(self.nodes & (self.at >= 0))
            kept &= defined[self.source]
        pairs = np.unique(self.source[kept] * max(self.count, 1) + self.at[kept])
        return pairs // max(self.count, 1), pairs % max(self.count, 1)

    def marked(self, rows: np.ndarray) -> np.ndarray:
        found = np.zeros(self.count, bool)
        found[self.at[rows]] = True
        return found

    def roots(self) -> np.ndarray:
        """Which rows are nodes that no edge leads to; a null task is one."""
        led = np.zeros(self.count + 1, bool)
        led[self.at[self.kind == EDGE]] = True
        led[-1] = False
        return self.nodes & ~led[self.at]

    def bits(self) -> tuple[np.ndarray, np.ndarray]:
        """Every vertex as a bit of its graph, and the first vertex of its graph."""
        first = np.searchsorted(self.owner, self.owner)
        local = np.arange(self.count) - first
        bit = np.zeros((self.count, int(local.max(initial=0)) // 64 + 1), np.uint64)
        bit[np.arange(self.count), local // 64] = np.uint64(1) << (local % 64).astype(np.uint64)
        return bit, first

    def out(self, rows: np.ndarray, **columns) -> pa.RecordBatch:
        taken = self.keys.take(pa.array(self.graph[rows]))
        return pa.RecordBatch.from_arrays([taken, *columns.values()], [self.name, *columns])


def _closure(bit: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The vertices each vertex leads to by one edge or more; edges ordered by ``src``."""
    reach = np.zeros_like(bit)
    if not len(src):
        return reach
    starts = np.flatnonzero(np.diff(src, prepend=-1))
    heads = src[starts]
    while True:
        wider = np.bitwise_or.reduceat(bit[dst] | reach[dst], starts, axis=0)
        if np.array_equal(wider, reach[heads]):
            return reach
        reach[heads] = wider


def levels(batch: _Batch) -> pa.RecordBatch:
    """(task, lvl) of every node row; null on or behind a cycle."""
    src, dst = batch.edges(known=True)
    level, need = np.full(batch.count, -1), np.bincount(dst, minlength=batch.count)
    free, at = need == 0, 0
    while free.any():
        level[free] = at
        told = np.bincount(dst[free[src]], minlength=batch.count)
        need = need - told
        free, at = (need == 0) & (told > 0), at + 1
    rows = np.flatnonzero(batch.nodes)
    found = np.where(batch.at[rows] >= 0, np.append(level, -1)[batch.at[rows]], -1)
    return batch.out(rows, task=batch.task.take(pa.array(rows)), lvl=pa.array(found.astype(np.int32), mask=found < 0))


def cyclic(batch: _Batch) -> pa.RecordBatch:
    """(task, component) of the tasks on a cycle; the component is named after its smallest task."""
    src, dst = batch.edges(known=True)
    bit, first = batch.bits()
    order = np.lexsort((src, dst))
    mutual = _closure(bit, src, dst) & _closure(bit, dst[order], src[order])
    on = np.flatnonzero((mutual & bit).any(axis=1))
    word = (mutual[on] != 0).argmax(axis=1)
    value = mutual[on, word]
    lowest = np.log2((value & (~value + np.uint64(1))).astype(np.float64)).astype(np.int64)
    least = first[on] + word * 64 + lowest
    rows = batch.named[on] % len(batch.graph)
    name = lambda vertices: batch.names.take(pa.array(batch.named[vertices]))
    return batch.out(rows, task=name(on), component=name(least))


def unreachable(batch: _Batch) -> pa.RecordBatch:
    """(task) of every node row that no root leads to, in graphs with a root; a null task is a root that nothing leads to."""
    src, dst = batch.edges(known=False)
    root_rows = batch.roots()
    rooted = np.zeros(len(batch.keys), bool)
    rooted[batch.graph[root_rows]] = True
    found = batch.marked(root_rows & (batch.at >= 0))
    new = found
    while new.any():
        told = np.zeros(batch.count, bool)
        told[dst[new[src]]] = True
        new = told & ~found
        found = found | new
    rows = np.flatnonzero(batch.nodes & rooted[batch.graph] & ~np.append(found, False)[batch.at])
    return batch.out(rows, task=batch.task.take(pa.array(rows)))


def depending(batch: _Batch) -> pa.RecordBatch:
    """(task, other, rest, hit) of every pair row: does ``other`` lead to ``task``?"""
    src, dst = batch.edges(known=False)
    bit, _ = batch.bits()
    reach = _closure(bit, src, dst)
    rows = np.flatnonzero(batch.kind == PAIR)
    whole = (batch.at[rows] >= 0) & (batch.source[rows] >= 0)
    hit = np.zeros(len(rows), bool)
    asked = rows[whole]
    hit[whole] = (reach[batch.source[asked]] & bit[batch.at[asked]]).any(axis=1)
    taken = pa.array(rows)
    return batch.out(rows, task=batch.task.take(taken), other=batch.src.take(taken), rest=batch.rest.take(taken), hit=pa.array(hit))


def unknown(batch: _Batch) -> pa.RecordBatch:
    """(task, dependency) of every edge row that starts at no node."""
    defined = np.append(batch.marked(batch.nodes & (batch.at >= 0)), False)
    rows = np.flatnonzero((batch.kind == EDGE) & ~defined[batch.source])
    return batch.out(rows, task=batch.task.take(pa.array(rows)), dependency=batch.src.take(pa.array(rows)))


def rootless(batch: _Batch) -> pa.RecordBatch:
    """The graphs that have nodes, none of which is without edges to it."""
    some, rooted = np.zeros(len(batch.keys), bool), np.zeros(len(batch.keys), bool)
    some[batch.graph[batch.nodes]] = True
    rooted[batch.graph[batch.roots()]] = True
    return pa.RecordBatch.from_arrays([batch.keys.take(pa.array(np.flatnonzero(some & ~rooted)))], [batch.name])
