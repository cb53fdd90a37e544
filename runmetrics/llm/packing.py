"""Best-fit packing of tokenised documents by hierarchical residual packing.

Each partition tokenises its documents, cuts those over the capacity, and packs the pieces best-fit decreasing into
bins. Nearly full bins are finished; the others go up a tree as items. Each node packs the items of ``ARITY`` children
best-fit decreasing, finishes the nearly full bins and passes the rest on; the root finishes all. Where underfull bins
hold over a sixteenth of the tokens, as in a partition of few documents, they are taken apart and passed on by the item,
because small items still fit anywhere.

Items of equal length are interchangeable in a node, so a node works on the counts of its children's items by length:
at most 1 019 rows a child, whatever the input. It writes steps: which ranks among a child's items of one length go to
which place of the node's bins. The pieces of unfinished bins then follow the steps of their level by a join.

A null text is empty and is still a document: its one token is the end mark. Documents of more than the capacity are
cut so that every piece but the first is full, and a text of any length is tokenised whole. Rows that repeat an id are
packed each for itself; an empty table gives no rows; other columns take no part. A task holds ids, lengths and places
of the pieces of its partition, about 100 bytes a piece, but no texts or tokens.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .bpe import COMMON, Splitter
from .common import written

CAPACITY = 1024
END = 2
NEARLY_FULL = 4  # tokens that may be missing in a finished bin
LOOSE = 16  # underfull bins that hold over one part in so many of a node's tokens are taken apart
ARITY = 8  # children of a node
BATCH_ROWS = 50_000
RANKS = "byte_bpe_50k.tiktoken"
_BIN = 40  # bits of a bin's number in its node


class Tokens:
    """Ids of the vocabulary. The ranks file holds the same vocabulary; what it can't cover goes to the library."""

    def __init__(self):
        self.splitter = Splitter()
        with open(public_tokenizers.path(RANKS), "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        special = any(mark in text for mark in self.splitter.special)
        found = self.splitter.tokenizer.encode(text, add_special_tokens=False).ids if special or COMMON.search(text) else self.fast.encode_ordinary(text)
        return np.array([*found, END], "<u4")


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    first = length % capacity or min(length, capacity)
    starts = [0, *range(first, length, capacity)] if length else []
    return [(start, end - start) for start, end in zip(starts, [*starts[1:], length])]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin of each item, its offset there, and what each bin holds."""
    bins, offsets, fills = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free room
    rooms = 0  # bit r is set when a bin with room r is open
    for item, size in zip(np.argsort(-sizes, kind="stable").tolist(), np.sort(sizes)[::-1].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            which = open_at[room].pop()
            if not open_at[room]:
                rooms &= ~(1 << room)
        else:
            which, room = len(fills), capacity
            fills.append(0)
        bins[item], offsets[item] = which, fills[which]
        fills[which] += size
        if room > size:
            open_at[room - size].append(which)
            rooms |= 1 << (room - size)
    return bins, offsets, np.array(fills, np.int64)


def _pieces(capacity: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ids, columns = Tokens(), [], [[], [], [], [], []]
        row = 0
        for batch in batches:
            ids.append(batch.column("doc_id"))
            for text in batch.column("text"):
                found = tokens.ids(text.as_py() or "")
                for piece, (start, length) in enumerate(cut(len(found), capacity)):
                    for column, value in zip(columns, (row, piece, start, length, zlib.crc32(found[start:start + length].tobytes()))):
                        column.append(value)
                row += 1
        if not row:
            return
        rows, piece, start, length, crc = (np.array(c, np.int64) for c in columns)
        which, offset, fills = best_fit(length, capacity)
        loose = fills[which] < capacity - NEARLY_FULL
        if LOOSE * length[loose].sum() > length.sum():
            fills[which[loose]] = 0
            which[loose], offset[loose] = len(fills) + np.arange(loose.sum()), 0
            fills = np.append(fills, length[loose])
        node = TaskContext.get().partitionId()
        order = np.argsort(fills, kind="stable")
        rank = np.empty(len(fills), np.int64)  # of a bin among those of its fill
        rank[order] = np.arange(len(fills)) - np.searchsorted(fills[order], fills[order], side="left")
        ids = pa.chunked_array(ids).combine_chunks()
        for at in range(0, len(rows), BATCH_ROWS):
            part = slice(at, at + BATCH_ROWS)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows[part])), pa.array(piece[part], pa.int32()), *(pa.array(c[part]) for c in (start, length, crc, offset)),
                 pa.array(np.full(len(rows[part]), node)), pa.array(fills[which[part]]), pa.array(rank[which[part]]), pa.array(which[part])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "offset", "node", "fill", "rank", "bin"])

    return work


def merge_fills(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing of ``counts`` items of each length, all items of one length and all places of one room at once.

    Moves (length, rank, times, shift, bin): from that rank on, each ``times`` items of the length go one behind the other
    to ``shift`` in the bins bin, bin + 1 and so on, up to the next rank of the length. Bins (bin, number, fill): the fill
    of ``number`` bins from that one on.
    """
    moves, made = [], 0
    open_at: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free room: (first bin, number of bins)
    rooms = 0  # bit r is set when a bin with room r is open

    def put(room: int, first: int, number: int):
        nonlocal rooms
        if number:
            open_at[room].append((first, number))
            rooms |= 1 << room

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fitting = rooms >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                first, number = open_at[room].pop()
                if not open_at[room]:
                    rooms &= ~(1 << room)
            else:
                room, first, number = capacity, made, -(-left // (capacity // length))
                made += number
            times = room // length
            whole = min(number, left // times)
            if whole:
                moves.append((length, rank, times, capacity - room, first))
                put(room - times * length, first, whole)
                rank, left = rank + whole * times, left - whole * times
            if left and whole < number:  # too few for one more bin as full
                moves.append((length, rank, left, capacity - room, first + whole))
                put(room - left * length, first + whole, 1)
                left, whole = 0, whole + 1
            put(room, first + whole, number - whole)
    bins = sorted((first, number, capacity - room) for room, ranges in enumerate(open_at) for first, number in ranges)
    return np.array(moves, np.int64).reshape(-1, 5), np.array(bins, np.int64).reshape(-1, 3)


def _steps(moves: np.ndarray, bins: np.ndarray, counts: dict[int, int], full: int) -> tuple[dict[int, list[tuple[int, ...]]], dict[int, int]]:
    """What becomes of the items of each length, and the number of passed on and finished bins of each fill.

    The moves cut where the fill of their bins changes: (rank, times, shift, bin, fill, the bin's rank in its fill). Bins
    that hold less than ``full`` are taken apart: each item is a bin of its own.
    """
    ranks, seen = [], {}
    for _, number, fill in bins.tolist():
        ranks.append(seen.get(fill, 0))
        if fill >= full:
            seen[fill] = ranks[-1] + number
    steps: dict[int, list[tuple[int, ...]]] = {}
    moves = moves.tolist()
    for at, (length, rank, times, shift, first) in enumerate(moves):
        more = at + 1 < len(moves) and moves[at + 1][0] == length
        ends = moves[at + 1][1] if more else counts[length]
        reach = first + -(-(ends - rank) // times)
        which = int(np.searchsorted(bins[:, 0], first, side="right")) - 1
        while which < len(bins) and bins[which, 0] < reach:
            begin, number, fill = bins[which].tolist()
            into, upto = max(begin, first), min(begin + number, reach)
            start, end = rank + (into - first) * times, min(ends, rank + (upto - first) * times)
            if fill >= full:
                step = start, times, shift, into, fill, ranks[which] + into - begin
            else:
                step = start, 1, 0, 0, length, seen.get(length, 0)
                seen[length] = step[-1] + end - start
            steps.setdefault(length, []).append(step)
            which += 1
    return steps, seen


_STEP = ("rank", "times", "shift", "bin", "fill", "place")
_MERGED = f"node long, fill long, n long, steps array<struct<{', '.join(f'{name}: long' for name in _STEP)}>>"


def _merge(capacity: int, root: bool):
    """For the items of a node's children by (child, fill): steps of each child and fill, and the node's own bins (steps null)."""
    nearly = capacity - NEARLY_FULL

    def work(parent: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["fill", "node"])
        totals = items.groupby("fill")["n"].sum()
        counts = dict(zip(totals.index.tolist(), totals.tolist()))
        moves, bins = merge_fills(counts, capacity)
        held = bins[:, 1] * bins[:, 2]
        loose = not root and LOOSE * held[bins[:, 2] < nearly].sum() > held.sum()
        steps, passed = _steps(moves, bins, counts, nearly if loose else 0)
        rows = [(int(parent[0]), fill, n, None) for fill, n in passed.items()]
        for fill, own in items.groupby("fill"):
            starts = np.array([step[0] for step in steps[fill]])
            before = 0
            for node, n in zip(own["node"].tolist(), own["n"].tolist()):
                # the child's items have the ranks before .. before + n - 1 among those of all children
                begin, end = np.searchsorted(starts, [before, before + n - 1], side="right") - [1, 0]
                rows.append((node, fill, n, [dict(zip(_STEP, (rank - before, *rest))) for rank, *rest in steps[fill][begin:end]]))
                before += n
        return pd.DataFrame(rows, columns=["node", "fill", "n", "steps"])

    return work


def _parent() -> Column:
    return F.expr(f"node div {ARITY}")


def _moved(pieces: DataFrame, steps: DataFrame, columns: list[str]) -> DataFrame:
    """Pieces in the bins of their parent node."""
    step = F.element_at("steps", F.size(F.filter("steps", lambda s: s["rank"] <= F.col("rank"))))
    which, place = F.expr("(rank - step.rank) div step.times"), F.expr("(rank - step.rank) % step.times")
    return pieces.join(steps, ["node", "fill"]).withColumn("step", step).select(
        *columns, (F.col("offset") + F.col("step.shift") + place * F.col("fill")).alias("offset"), _parent().alias("node"),
        F.col("step.fill").alias("fill"), (F.col("step.place") + which).alias("rank"), (F.col("step.bin") + which).alias("bin"))


def pack(docs: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    columns = {"doc_id": kind, "piece": "int", "start": "long", "length": "long", "ids_crc32": "long"}
    described = ", ".join(f"{name} {of}" for name, of in columns.items())
    pieces = written(source.mapInArrow(_pieces(capacity), f"{described}, offset long, node long, fill long, rank long, bin long"), "pieces")
    full, first = F.col("fill") >= capacity - NEARLY_FULL, 0  # first: number of the level's first node among all nodes

    def finished(rows: DataFrame) -> DataFrame:
        return rows.select(*columns, (F.shiftleft(F.col("node") + first, _BIN) + F.col("bin")).alias("sequence_id"), "offset")

    # each bin has one piece at its begin
    items = written(pieces.filter(~full & (F.col("offset") == 0)).groupBy("node", "fill").agg(F.count("*").alias("n")), "items")
    packed, nodes = finished(pieces.filter(full)), pieces.agg(F.max("node")).first()[0]
    nodes = 0 if nodes is None else nodes + 1
    while not items.isEmpty():
        first, nodes = first + nodes, -(-nodes // ARITY)
        merged = written(items.groupBy(_parent()).applyInPandas(_merge(capacity, nodes == 1), _MERGED), "merged")
        pieces = written(_moved(pieces.filter(~full), merged.filter("steps is not null").drop("n"), list(columns)), "moved")
        if nodes == 1:
            return packed.unionByName(finished(pieces))
        packed = packed.unionByName(finished(pieces.filter(full)))
        items = merged.filter(F.col("steps").isNull() & ~full).select("node", "fill", "n")
    return packed
