"""Approximate nearest neighbours by cosine, with randomly rotated one-bit codes.

Unit vectors are put in lists around centroids. Of each vector's residual in its list, o = (v - c) / |v - c|, the index
keeps the signs of the rotated residual as packed bits and two scalars: |v - c| and f, the inner product of o and its
code. For a query residual q, <code, q> / f estimates <o, q> with an error of at most about ``WIDTH`` sqrt(1 - f^2) /
(f sqrt(d - 1)). From the estimates with their bounds each block of a list yields the vectors that can be among the k
nearest; these are reranked by the exact cosine in double precision.

The rotation and the centroids are fitted on at most about ``SAMPLE`` vectors, chosen by the hash of their id; every
vector is indexed. A query looks into the lists with the nearest centroids. How many is fitted, too: as many as it takes
for ``TARGET`` of the nearest neighbours within the sample to lie in them (in all data neighbours are no farther, so the
share found is no lower). Lists are split into blocks of about
``BLOCK`` vectors and the queries of a list into blocks of ``QUERIES``, by the place of the row, so that no task meets more
than one block of each, also when a third of all vectors, or of all ids, are one and the same.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id.
Vectors of different dimensions are never compared; those of a dimension that the sample misses are one list.
Ties go to the smaller id. An id that is repeated counts with the best of its vectors, and is no candidate for itself.
With fewer than k candidates all found are returned; an empty table gives no rows. Other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

NEAREST = 5
SAMPLE = 20_000
LISTS = 1024  # at most
TARGET = 0.98
BLOCK, QUERIES = 8192, 1024
WIDTH = 3.0
_SLACK = 1e-4  # of single precision in the estimates
_ROUNDS = 8
_TRIED = 400
_STEPS = 1 << 62


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component near one: cosines stay the same to the bit."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = _scaled(vectors)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


class Index:
    """Centroids and a rotation for each dimension of the sample."""

    def __init__(self, sample: list[np.ndarray], lists: int, k: int, target: float, seed: int = 42):
        self.centroids: dict[int, np.ndarray] = {}
        self.probes: dict[int, int] = {}
        self.seed = seed
        self._rotations: dict[int, np.ndarray] = {}
        by: dict[int, list[np.ndarray]] = {}
        for vector in sample:
            by.setdefault(len(vector), []).append(vector)
        for dimension, vectors in by.items():
            units = _units(np.array(vectors, float))
            self.centroids[dimension] = self._cluster(units, max(1, round(lists * len(vectors) / len(sample))))
            self.probes[dimension] = self._enough(units, k, target)

    def _cluster(self, units: np.ndarray, lists: int) -> np.ndarray:
        random = np.random.default_rng(self.seed)
        distinct = np.unique(units, axis=0)
        centroids = distinct[random.choice(len(distinct), min(lists, len(distinct)), replace=False)]
        for _ in range(_ROUNDS):
            nearest = (units @ centroids.T).argmax(axis=1)
            sums = np.zeros_like(centroids)
            np.add.at(sums, nearest, units)
            sizes = np.sqrt((sums * sums).sum(axis=1))
            centroids = np.where(sizes[:, None] > 1e-9, sums / np.maximum(sizes, 1e-9)[:, None], centroids)
        return centroids

    def _enough(self, units: np.ndarray, k: int, target: float) -> int:
        """How many lists hold that share of the k nearest neighbours within the sample."""
        dimension, step = units.shape[1], max(1, len(units) // _TRIED)
        lists = self.nearest(units, 1)[:, 0]
        places = []
        for at in range(0, len(units), step):
            cosines = units @ units[at]
            cosines[at] = -np.inf
            near = np.argsort(-cosines, kind="stable")[:min(k, len(units) - 1)]
            places += np.argsort(self.nearest(units[at:at + 1], len(self.of(dimension)))[0])[lists[near]].tolist()
        return int(np.quantile(places, target, method="higher")) + 1 if places else 1

    def rotation(self, dimension: int) -> np.ndarray:
        if dimension not in self._rotations:
            random = np.random.default_rng(self.seed + dimension)
            self._rotations[dimension] = np.linalg.qr(random.standard_normal((dimension, dimension)))[0]
        return self._rotations[dimension]

    def of(self, dimension: int) -> np.ndarray:
        return self.centroids.get(dimension, np.zeros((1, dimension)))

    def nearest(self, units: np.ndarray, count: int) -> np.ndarray:
        centroids = self.of(units.shape[1])
        return np.argsort(-(units @ centroids.T), axis=1, kind="stable")[:, :count]

    def encode(self, units: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed codes, the length of the residual, and the inner product of residual and code."""
        dimension = units.shape[1]
        rotated = (units - self.of(dimension)[lists]) @ self.rotation(dimension).T
        length = np.sqrt((rotated * rotated).sum(axis=1))
        factor = np.abs(rotated).sum(axis=1) / (np.maximum(length, 1e-30) * math.sqrt(dimension))
        return np.packbits(rotated > 0, axis=1), length, np.where(length > 1e-12, factor, 1.0)

    def bounds(self, codes: np.ndarray, lengths: np.ndarray, factors: np.ndarray, queries: np.ndarray, of: int) -> tuple[np.ndarray, np.ndarray]:
        """The estimated cosine of each query (row) and coded vector of list ``of``, and its possible error."""
        dimension = queries.shape[1]
        signs = (np.unpackbits(codes, axis=1, count=dimension).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dimension))
        rotated = (queries - self.of(dimension)[of]) @ self.rotation(dimension).T
        own = (rotated * rotated).sum(axis=1)
        product = rotated.astype(np.float32) @ signs.T * (lengths / factors).astype(np.float32)
        estimate = 1 - (own[:, None] + (lengths * lengths)[None, :]) / 2 + product
        error = WIDTH * np.sqrt(np.maximum(1 - factors * factors, 0)) / (factors * math.sqrt(max(dimension - 1, 1))) * lengths
        return estimate, np.sqrt(own)[:, None] * error[None, :] + _SLACK


def usable(vector: Column) -> Column:
    """Not null, not empty, finite everywhere, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def _matrix(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of a batch, one pair a dimension."""
    column = batch.column("vector")
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for dimension in np.unique(sizes):
        rows = np.flatnonzero(sizes == dimension)
        yield rows, values[offsets[rows][:, None] + np.arange(dimension)]


def _indexed(index: Index):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, vectors in _matrix(batch):
                units = _units(vectors)
                lists = index.nearest(units, 1)[:, 0]
                codes, lengths, factors = index.encode(units, lists)
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("vector"), pa.array(np.full(len(rows), vectors.shape[1], np.int32)), pa.array(lists.astype(np.int32)),
                     pa.array([code.tobytes() for code in codes], pa.binary()), pa.array(lengths), pa.array(factors)],
                    ["id", "vector", "dim", "list", "code", "length", "factor"])

    return work


def _routed(index: Index):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, vectors in _matrix(batch):
                lists = index.nearest(_units(vectors), index.probes.get(vectors.shape[1], 1))
                part = batch.take(pa.array(np.repeat(rows, lists.shape[1])))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("vector"), pa.array(np.full(lists.size, vectors.shape[1], np.int32)), pa.array(lists.ravel().astype(np.int32))],
                    ["id", "vector", "dim", "list"])

    return work


def _search(index: Index, k: int):
    def work(key: tuple, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, ...]] = []
        if len(queries) and len(block):
            vectors, wanted = (_scaled(np.stack(side["vector"].to_numpy()).astype(float)) for side in (block, queries))
            codes = np.frombuffer(b"".join(block["code"]), np.uint8).reshape(len(block), -1)
            ids, own, lengths, factors = block["id"].to_numpy(), queries["id"].to_numpy(), block["length"].to_numpy(), block["factor"].to_numpy()
            norms = np.sqrt((vectors * vectors).sum(axis=1))
            known, which = np.unique(ids, return_inverse=True)
            for at in range(0, len(queries), 128):
                part = wanted[at:at + 128]
                estimate, error = index.bounds(codes, lengths, factors, _units(part), int(key[1]))
                for row, query in enumerate(part):
                    low, high = estimate[row] - error[row], estimate[row] + error[row]
                    low[ids == own[at + row]] = high[ids == own[at + row]] = -np.inf
                    lows = low
                    if len(known) < len(ids):  # an id that is repeated fills one place only
                        lows = np.full(len(known), -np.inf)
                        np.maximum.at(lows, which, low)
                    floor = np.partition(lows, -k)[-k] if len(lows) > k else -np.inf
                    rows = np.flatnonzero((high >= floor) & (high > -np.inf))
                    exact = (vectors[rows] * query).sum(axis=1) / (norms[rows] * math.sqrt((query * query).sum()))
                    best = np.lexsort((ids[rows], -exact))
                    best = best[np.sort(np.unique(ids[rows][best], return_index=True)[1])[:k]]
                    found.append((np.full(len(best), own[at + row]), ids[rows][best], exact[best]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [[], [], []]
        return pd.DataFrame({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return work


def nearest(vectors: DataFrame, is_query: Column, k: int = NEAREST, target: float = TARGET, id_column: str = "vec_id", vector_column: str = "embedding",
            sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, among all vectors but its own."""
    source = (vectors.filter(usable(F.col(vector_column)) & F.col(id_column).isNotNull())
              .select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"), is_query.alias("asks")))
    total = source.count()
    hashed = F.xxhash64("id").bitwiseAND(F.lit(_STEPS - 1))
    # about ``sample`` ids, one vector each
    fitted = source.filter(hashed < min(_STEPS, _STEPS * sample // max(total, 1) + 1)).groupBy("id").agg(F.min("vector").alias("vector")).toPandas()
    index = Index([np.asarray(v) for v in fitted.sort_values("id", kind="stable")["vector"]], min(LISTS, max(1, round(math.sqrt(total)))), k, target)
    salt = F.xxhash64(F.monotonically_increasing_id())  # rows are dealt to blocks by their place, so that rows of one id are, too
    coded = written(source.select("id", "vector").mapInArrow(
        _indexed(index), "id long, vector array<double>, dim int, list int, code binary, length double, factor double").withColumn("salt", salt), "codes")
    routed = written(source.filter("asks").select("id", "vector").mapInArrow(_routed(index), "id long, vector array<double>, dim int, list int").withColumn("salt", salt), "queries")
    # a row for each list: how many blocks of vectors and of queries it has
    sizes = (coded.groupBy("dim", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
             .join(routed.groupBy("dim", "list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("asked")), ["dim", "list"]))
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    spread = coded.join(sizes, ["dim", "list"]).withColumn("block", F.pmod("salt", F.col("blocks")).cast("int")).withColumn("turn", F.explode(span("asked")))
    asked = routed.join(sizes, ["dim", "list"]).withColumn("turn", F.pmod("salt", F.col("asked")).cast("int")).withColumn("block", F.explode(span("blocks")))
    keys = ["dim", "list", "block", "turn"]
    found = asked.select(*keys, "id", "vector").groupBy(*keys).cogroup(
        spread.select(*keys, "id", "vector", "code", "length", "factor").groupBy(*keys)).applyInPandas(_search(index, k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
