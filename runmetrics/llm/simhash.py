"""Near duplicates by SimHash, found with the generalised pigeonhole principle.

A text is lower-cased (A-Z), cut in words at ASCII white space, and its shingles of ``SHINGLE`` words are hashed with
XXH64 (seed 42); a bit of the fingerprint is 1 when it is set in more than half of the hashes. Fingerprints that differ
in at most ``DISTANCE`` bits are linked, and linked ones are one component.

Equal fingerprints collapse first, so copies make no links. The bits are grouped into ``PARTS`` partitions such that
correlated bits share one. Two fingerprints within distance t agree, for thresholds t_1..t_m >= -1 that add up to
t - m + 1, in some part i up to t_i bits (-1: the part is not probed). Each fingerprint gets its thresholds by dynamic
programming over estimated candidates and probes, so parts where its value is crowded are avoided. It is looked up
under its own part values by the others, probes all values within its thresholds, and every candidate is verified.

Estimates come from counts of the values of 16-bit halves of the parts over all fingerprints, a table of fixed size.
Within a tight group fingerprints next to each other (1 bit) are linked first; the probes then only report pairs that
no such link has joined, so that a large group of near copies doesn't list its pairs.

Texts without words, null ones too, have fingerprint 0, linked like any other. ``component_id`` is the smallest doc_id
of the component. Rows that repeat an id each get a row; null ids take part but name no component (null only if all
are). An empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import per_text, written
from .components import components

BITS = 64
SHINGLE, DISTANCE, PARTS = 3, 3, 2
SEED = 42
PROBE_COST = 1.0  # of a probe, in candidates
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_HALF = 16
_BLOCK = 1 << 16
_ONE = np.uint64(1)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1]
    size = min(shingle, len(words))
    spans = zip(begins[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())
    hashed = xxhash.xxh64_intdigest
    total, counts = len(words) - size + 1, np.zeros(BITS, np.int64)
    hashes = np.fromiter((hashed(line[a:b], SEED) for a, b in spans), np.uint64, total)
    for at in range(0, total, _BLOCK):
        counts += np.unpackbits(hashes[at:at + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    make = lambda: lambda texts: [(_signed(fingerprint(text, shingle)),) for text in texts]
    return source.mapInArrow(per_text(make, [("fp", pa.int64())]), f"doc_id {kind}, fp long")


def _values(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)


def _bit_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of bits (i * 64 + j) in how many fingerprints both are set."""
    sums = np.zeros((BITS, BITS))
    for batch in batches:
        bits = np.unpackbits(_values(batch).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
        sums += bits.T @ bits
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS, dtype=np.int32)), pa.array(sums.astype(np.int64).ravel())], ["pair", "n"])


def group_bits(both: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """Bits (0: the highest) in groups of about equal size, each grown by the bit most correlated with it."""
    shares = both / max(total, 1)
    single = shares.diagonal()
    spread = np.sqrt(np.maximum(single * (1 - single), 1e-12))
    related = np.abs((shares - np.outer(single, single)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    left, groups = set(range(BITS)), []
    for part in range(parts):
        size = -(-len(left) // (parts - part))
        rest = sorted(left)
        group = [rest[int(related[np.ix_(rest, rest)].sum(axis=1).argmax())]]
        left.discard(group[0])
        while len(group) < size:
            rest = sorted(left)
            group.append(rest[int(related[np.ix_(rest, group)].sum(axis=1).argmax())])
            left.discard(group[-1])
        groups.append(sorted(group))
    return groups


class Plan:
    """Parts of the fingerprint, and estimates of how many fingerprints are near a part's value."""

    def __init__(self, groups: list[list[int]], distance: int = DISTANCE):
        self.groups, self.distance, self.total = groups, distance, 0
        self.halves = [(part, at, min(at + _HALF, len(group))) for part, group in enumerate(groups) for at in range(0, len(group), _HALF)]
        self.near: list[np.ndarray] = []  # by half: [difference, value] -> share of fingerprints

    def parts(self, values: np.ndarray) -> list[np.ndarray]:
        """The value of each part, its bits packed."""
        out = []
        for group in self.groups:
            packed = np.zeros(len(values), np.uint64)
            for bit in group:
                packed = packed << _ONE | (values >> np.uint64(BITS - 1 - bit) & _ONE)
            out.append(packed)
        return out

    def half(self, parts: list[np.ndarray], which: int) -> np.ndarray:
        part, begin, end = self.halves[which]
        return (parts[part] >> np.uint64(len(self.groups[part]) - end) & np.uint64((1 << (end - begin)) - 1)).astype(np.int64)

    def learn(self, counts: list[np.ndarray], total: int) -> None:
        """``counts``: by half, how many fingerprints have each value."""
        self.total = total
        for (_, begin, end), count in zip(self.halves, counts):
            width = end - begin
            # exactly d bits away: flipping one bit after the other, each flipped or not
            rings = [count.astype(np.float64)] + [np.zeros(1 << width) for _ in range(self.distance)]
            for bit in range(width):
                turned = np.arange(1 << width) ^ (1 << bit)
                rings = [rings[d] + (rings[d - 1][turned] if d else 0) for d in range(self.distance + 1)]
            self.near.append(np.stack(rings) / max(total, 1))

    def thresholds(self, values: np.ndarray) -> np.ndarray:
        """The cheapest thresholds of each fingerprint, a column a part."""
        parts, most = self.parts(values), self.distance
        costs = []  # by part: [threshold + 1, fingerprint]
        for part, group in enumerate(self.groups):
            rings = None
            for which, (owner, _, _) in enumerate(self.halves):
                if owner == part:
                    own = self.near[which][:, self.half(parts, which)]
                    rings = own if rings is None else np.stack([sum(rings[a] * own[d - a] for a in range(d + 1)) for d in range(most + 1)])
            probes = np.cumsum([math.comb(len(group), d) for d in range(most + 1)])
            costs.append(np.concatenate([np.zeros((1, len(values))), np.cumsum(rings, axis=0) * self.total + PROBE_COST * probes[:, None]]))
        # cheapest way to spend s = sum of (threshold + 1) over the parts so far
        spend = most + 1
        best = np.full((spend + 1, len(values)), np.inf)
        best[0] = 0
        choices = []
        for cost in costs:
            options = np.stack([np.stack([best[s - k] + cost[k] if k <= s else np.full(len(values), np.inf) for k in range(most + 2)]) for s in range(spend + 1)])
            choices.append(options.argmin(axis=1))
            best = options.min(axis=1)
        out, s = np.empty((len(values), len(self.groups)), np.int64), np.full(len(values), spend)
        for part in range(len(self.groups) - 1, -1, -1):
            taken = choices[part][s, np.arange(len(values))]
            out[:, part] = taken - 1
            s = s - taken
        return out


def _flips(width: int, most: int) -> np.ndarray:
    """All words of ``width`` bits with at most ``most`` bits set."""
    return np.array([sum(1 << b for b in bits) for d in range(most + 1) for bits in combinations(range(width), d)], np.uint64)


def _keys(part: int, values: np.ndarray) -> np.ndarray:
    """A part's value and its number as one long (two parts at least, so that the value leaves room)."""
    return (values * np.uint64(8) + np.uint64(part)).view(np.int64)


def _index(plan: Plan):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _values(batch)
            for part, own in enumerate(plan.parts(values)):
                yield pa.RecordBatch.from_arrays([pa.array(_keys(part, own)), batch.column("fp"), batch.column("near")], ["key", "x", "x_near"])

    return work


def _probes(plan: Plan):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = {}
        for batch in batches:
            values = _values(batch)
            signed, near = batch.column("fp").to_numpy(zero_copy_only=False), batch.column("near").to_numpy(zero_copy_only=False)
            parts, chosen = plan.parts(values), plan.thresholds(values)
            for part, group in enumerate(plan.groups):
                for most in range(plan.distance + 1):
                    rows = np.flatnonzero(chosen[:, part] == most)
                    if not len(rows):
                        continue
                    if (part, most) not in flips:
                        flips[part, most] = _flips(len(group), most)
                    step = max(1, (1 << 18) // len(flips[part, most]))
                    for at in range(0, len(rows), step):
                        own = rows[at:at + step]
                        reached = (parts[part][own][:, None] ^ flips[part, most][None, :]).ravel()
                        times = len(flips[part, most])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(_keys(part, reached)), pa.array(np.repeat(signed[own], times)), pa.array(np.repeat(near[own], times))], ["key", "q", "q_near"])

    return work


def plan_parts(points: DataFrame, distance: int = DISTANCE, parts: int = PARTS) -> Plan:
    """Group the bits and count the values of the halves over all fingerprints (column ``fp``)."""
    both = np.zeros(BITS * BITS)
    for row in points.select("fp").mapInArrow(_bit_sums, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 4096 rows
        both[row["pair"]] = row["n"]
    both = both.reshape(BITS, BITS)
    total = points.count()
    plan = Plan(group_bits(both, total, parts), distance)

    def count(batches):
        sums = [np.zeros(1 << (end - begin), np.int64) for _, begin, end in plan.halves]
        for batch in batches:
            own = plan.parts(_values(batch))
            for which, into in enumerate(sums):
                into += np.bincount(plan.half(own, which), minlength=len(into))
        for which, into in enumerate(sums):
            at = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), which, np.int32)), pa.array(at.astype(np.int32)), pa.array(into[at])], ["half", "value", "n"])

    counts = [np.zeros(1 << (end - begin), np.int64) for _, begin, end in plan.halves]
    # at most 65536 rows for each of the four halves, whatever the input
    table = points.select("fp").mapInArrow(count, "half int, value int, n long").groupBy("half", "value").agg(F.sum("n").alias("n")).toPandas()
    for which, own in table.groupby("half"):
        counts[which][own["value"].to_numpy()] = own["n"].to_numpy()
    plan.learn(counts, total)
    return plan


def neighbours(points: DataFrame) -> DataFrame:
    """Links (a, b) of fingerprints that differ in one bit: the one with the bit looks for the one without it."""
    turned = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.struct(
        F.col("fp").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b)).alias("set"),
        F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)).alias("b")))
    probes = points.select(F.col("fp").alias("a"), F.explode(F.filter(turned, lambda t: t["set"] != 0)).alias("t")).select("a", F.col("t.b").alias("b"))
    return probes.join(points.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b")


def links(points: DataFrame, distance: int = DISTANCE, parts: int = PARTS) -> DataFrame:
    """Links (a, b) that connect the same fingerprints (column ``fp``, distinct) as all pairs within ``distance`` do."""
    points = points.select("fp")
    if distance == 0:
        return points.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    close = written(neighbours(points), "neighbours")
    joined = components(close)
    labelled = written(points.join(joined, points["fp"] == joined["node"], "left").select("fp", F.coalesce("component", "fp").alias("near")), "points")
    plan = plan_parts(labelled, distance, parts)
    index = labelled.mapInArrow(_index(plan), "key long, x long, x_near long")
    probes = labelled.mapInArrow(_probes(plan), "key long, q long, q_near long")
    found = probes.join(index, "key").filter((F.col("q") < F.col("x")) & (F.col("q_near") != F.col("x_near"))
                                             & (F.bit_count(F.col("q").bitwiseXOR(F.col("x"))) <= distance))
    return close.unionByName(found.select(F.col("q_near").alias("a"), F.col("x_near").alias("b")).distinct()).unionByName(
        joined.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    prints = written(fingerprints(docs, shingle, id_column, text_column), "fingerprints")
    points = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    linked = components(links(points, distance))
    labelled = points.join(linked, points["fp"] == linked["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    named = written(labelled.join(smallest, "component").select("fp", "component_id"), "components")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
