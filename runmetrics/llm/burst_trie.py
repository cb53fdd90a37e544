"""The prefix trie of conversations, built as a burst trie.

A node is a distinct sequence of first turns; the conversations that start with it are its members. Conversations of
equal turns are one class, known by its smallest member. A container holds the suffixes of all classes below one trie
head; while it has several classes and more than ``capacity`` suffix turns it bursts: its head becomes a node of the
shared trie and its classes move to one container for each next turn id. A round bursts all oversized containers of one
depth, so the rounds are the depth to which more classes than a container holds share their turns. The containers left
are sorted and swept into nodes, each whole in one task; those of a single class, of any length, need no gathering: each
of their turns is a node. What nodes gather from their subtree is summed from containers to heads, a depth a round.

Turns are told apart by 128 bits of the SHA-256 of role and text, classes by two 64-bit hashes over all turns. Turns are
numbered by a sort over ranges, which cuts a long conversation into several tasks, and each round is a written table, so
executors may be lost.

Turns follow each other by turn number, null first; rows that repeat a number follow each other by turn id. Null roles
and texts are empty. Rows without an id are one conversation, which counts as the largest. Repeated rows are turns like
any other. An empty table gives no nodes, a conversation without turns ends at the root. Texts of any length take part
whole, as digests and lengths. Other columns take no part.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F, types as T

from ..session import shared_dir
from .common import whole, written

# Turns that a container may hold: what one task sorts at a time.
CAPACITY = 256
# Turns, and ids, that are summed up or joined before they meet others of a long conversation or a large class.
BLOCK = 4096


def key(value: Column | str) -> Column:
    """An id that joins and sorts also when it is null: then it is the last."""
    value = F.col(value) if isinstance(value, str) else value
    return F.struct(value.isNull().alias("absent"), value.alias("id"))


def turn_id(role: Column, text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def numbered(conversations: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """conv, at (from 0, without gaps), id and chars of every turn, written."""
    role, text = whole(role_column), whole(text_column)
    rows = conversations.select(key(id_column).alias("conv"), F.col(turn_column).alias("turn"), turn_id(role, text).alias("id"), F.length(text).cast("long").alias("chars"))
    order = [F.col("conv").asc(), F.col("turn").asc_nulls_first(), F.col("id").asc(), F.col("salt").asc()]
    dealt = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(dealt.select("conv", "id", "chars", F.monotonically_increasing_id().alias("place")), "turns").withColumn("part", F.shiftright("place", 33))
    parts = placed.groupBy("conv", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    # conversations that lie in several parts go on where the part before ends; there are fewer than two a part
    before = parts.withColumn("before", F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n"))
    return written(placed.join(before.select("conv", "part", "first", "before"), ["conv", "part"]).select(
        "conv", (F.col("place") - F.col("first") + F.col("before")).alias("at"), "id", "chars"), "numbered")


class _Depths:
    """Tables of one schema, one for each depth, written to the shared folder and read together."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = f"{shared_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, depth: int, counted: str = "true") -> int:
        seen = Observation()
        df.observe(seen, F.count_if(F.expr(counted)).alias("n")).write.parquet(f"{self.path}/depth={depth}")
        return seen.get["n"]

    def at(self, depth: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/depth={depth}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("depth", T.LongType())])).parquet(self.path)


def classes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """conv, n (its turns) and rep (the smallest conversation of equal turns) of every conversation, written."""
    sums = turns.groupBy("conv").agg(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64(F.lit(seed), "at", "id")).alias(f"x{seed}") for seed in (1, 2)))
    zero = F.lit(0).cast("long")
    known = written(ids.select("conv").distinct().join(sums, "conv", "left").select("conv", *(F.coalesce(c, zero).alias(c) for c in ("n", "x1", "x2"))), "sequences")
    reps = known.groupBy("n", "x1", "x2").agg(F.min("conv").alias("rep"))
    return written(known.join(reps, ["n", "x1", "x2"]).select("conv", "n", "rep"), "classes")


def burst(turns: DataFrame, members: DataFrame, capacity: int) -> _Depths:
    """The containers at every depth, one row a class: rep, weight, n, head, up (the head above), last (characters of
    the last turn before the suffix), classes, and whether the container bursts (``big``)."""
    reps = members.groupBy("rep", "n").agg(F.count("*").alias("weight"))
    kind = members.schema["rep"].dataType
    least = members.agg(F.min("rep").alias("rep")).first()["rep"]
    root = F.lit(None).cast(kind) if least is None else F.struct(F.lit(least["absent"]).alias("absent"), F.lit(least["id"]).cast(kind["id"].dataType).alias("id"))
    held = written(reps.select("rep", "weight", "n", root.alias("head"), F.lit(None).cast(kind).alias("up"), F.lit(0).cast("long").alias("last")), "suffixes")
    depths, depth = None, 0
    while True:
        sizes = held.groupBy("head").agg(F.count("*").alias("classes"), F.sum(F.col("n") - depth + 1).alias("rows")).select(
            "head", "classes", ((F.col("classes") > 1) & (F.col("rows") > capacity)).alias("big"))
        marked = held.join(sizes, "head").select("rep", "weight", "n", "head", "up", "last", "classes", "big")
        depths = depths or _Depths(marked, "containers")
        if not depths.write(marked, depth, "big"):
            return depths
        moved = depths.at(depth).filter(F.col("big") & (F.col("n") > depth)).select("rep", "weight", "n", F.col("head").alias("up")).join(
            turns.filter(F.col("at") == depth).select(F.col("conv").alias("rep"), "id", F.col("chars").alias("last")), "rep")
        moved = written(moved, "moved")
        # written, so that the join may deal out a turn id that very many classes share
        heads = written(moved.groupBy("up", "id").agg(F.min("rep").alias("head")), "next")
        held = moved.join(heads, ["up", "id"]).select("rep", "weight", "n", "head", "up", "last")
        depth += 1


_NODE = [("conv", None), ("depth", pa.int64()), ("up", None), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
         ("saved", pa.int64()), ("ends", None), ("top", pa.bool_())]


def sweep(rows: Iterable[tuple], depth: int, up) -> list[list]:
    """The nodes of one container from its rows (rep, weight, id, chars), each class's turns in order.

    The first row of a class is the last turn of the container's head. Classes are sorted by their turn ids; the nodes of
    the class at hand are open, and those that the next one doesn't share are closed into their parent.
    """
    sequences = []
    for rep, turns in groupby(rows, key=lambda row: row[0]):
        turns = list(turns)
        sequences.append(([t[2] for t in turns[1:]], [t[3] for t in turns], rep, turns[0][1]))
    sequences.sort(key=lambda s: s[0])
    smaller = lambda a, b: min(a, b, key=lambda rep: (rep["absent"], rep["id"]))
    made, opened, before = [], [], []

    def close(to: int) -> None:
        while len(opened) > to:
            node = opened.pop()
            node[6] += (node[3] - 1) * node[9]
            node[5] = node[5] or 1
            if opened:
                parent = opened[-1]
                node[2] = parent
                parent[0] = smaller(parent[0], node[0])
                parent[3] += node[3]
                parent[4] += 1
                parent[5] += node[5]
                parent[6] += node[6]

    for ids, chars, rep, weight in sequences:
        shared = next((k for k, (a, b) in enumerate(zip(ids, before)) if a != b), min(len(ids), len(before)))
        close(shared + 1)
        for k in range(len(opened), len(ids) + 1):
            # conv, depth, up, n_convs, n_children, n_leaves, saved, ends, top, chars
            opened.append([rep, depth + k, None, 0, 0, 0, 0, None, not k, chars[k]])
            made.append(opened[-1])
        last = opened[-1]
        last[0], last[3], last[7] = smaller(last[0], rep), last[3] + weight, rep
        before = ids
    close(0)
    return [[node[0], node[1], up if node[8] else node[2][0], *node[3:9]] for node in made]


def _swept(kind: pa.DataType):
    """A function for ``mapInArrow`` over rows sorted by depth, head, rep and place."""
    fields = [(name, kind if of is None else of) for name, of in _NODE]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(name).to_pylist() for name in ("depth", "head", "up", "rep", "weight", "id", "chars")))

    def batch(nodes: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node[k] for node in nodes], of) for k, (_, of) in enumerate(fields)], [name for name, _ in fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = []
        for (depth, _, up), of in groupby(rows(batches), key=lambda row: row[:3]):
            ready += sweep((row[3:] for row in of), depth, up)
            if len(ready) >= 10_000:
                yield batch(ready)
                ready = []
        if ready:
            yield batch(ready)

    return work


def _chains(rows: DataFrame) -> DataFrame:
    """The nodes of containers of one class: every turn is one."""
    of = rows.withColumn("block", F.floor(F.col("at") / BLOCK))
    # characters from a turn to the end: of its block, then of the blocks behind
    behind = of.groupBy("rep", "block").agg(F.sum("chars").alias("all")).withColumn(
        "behind", F.sum("all").over(Window.partitionBy("rep").orderBy(F.col("block").desc())) - F.col("all")).select("rep", "block", "behind")
    inside = F.sum("chars").over(Window.partitionBy("rep", "block").orderBy(F.col("at").desc()))
    counted = of.withColumn("inside", inside).join(behind, ["rep", "block"])
    depth, end = F.col("at") + 1, F.col("at") + 1 == F.col("n")
    one = F.lit(1).cast("long")
    return counted.select(
        F.col("rep").alias("conv"), depth.alias("depth"), F.when(depth == F.col("depth"), F.col("up")).otherwise(F.col("rep")).alias("up"),
        F.col("weight").alias("n_convs"), F.when(end, 0).otherwise(one).alias("n_children"), one.alias("n_leaves"),
        ((F.col("weight") - 1) * (F.col("inside") + F.col("behind"))).alias("saved"), F.when(end, F.col("rep")).alias("ends"), (depth == F.col("depth")).alias("top"))


def trie_nodes(turns: DataFrame, members: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The nodes of the trie: conv (smallest member), depth, up (the parent's), n_convs, n_children, n_leaves, saved
    (characters that shared turns save in the subtree), ends (the class that ends here)."""
    depths = burst(turns, members, capacity)
    containers = depths.all()
    resting = containers.filter(~F.col("big")).drop("big")
    # the row before the suffix is the last turn of the head; the root has none
    source = turns.select(F.col("conv").alias("rep"), "at", "id", "chars")
    head = resting.filter(F.col("depth") == 0).select("rep", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("binary").alias("id"), F.lit(0).cast("long").alias("chars"))
    rows = source.unionByName(head).join(resting, "rep").filter(F.col("at") >= F.col("depth") - 1)
    chains = written(_chains(rows.filter(F.col("classes") == 1)), "chains")
    several = rows.filter(F.col("classes") > 1).select("depth", "head", "up", "rep", "weight", "at", "id", "chars").repartition("depth", "head")
    conv = members.schema["rep"].dataType
    found = "conv {0}, depth long, up {0}, n_convs long, n_children long, n_leaves long, saved long, ends {0}, top boolean".format(conv.simpleString())
    swept = several.sortWithinPartitions("depth", "head", "rep", "at").mapInArrow(_swept(_arrow(conv)), found)
    resting_nodes = chains.unionByName(written(swept, "swept"))
    burst_heads = written(containers.filter("big").groupBy("depth", "head").agg(
        F.min("up").alias("up"), F.sum("weight").alias("n_convs"), F.min(F.when(F.col("n") == F.col("depth"), F.col("rep"))).alias("ends"), F.min("last").alias("last")), "heads")
    deepest = burst_heads.agg(F.max("depth").alias("d")).first()["d"]
    if deepest is None:
        return resting_nodes.drop("top")
    heads, below = None, None
    tops = resting_nodes.filter("top").select("depth", "up", "n_leaves", "saved")
    for depth in range(deepest, -1, -1):
        under = tops.filter(F.col("depth") == depth + 1).drop("depth")
        under = under if below is None else under.unionByName(below)
        sums = under.groupBy(F.col("up").alias("head")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("under"))
        done = burst_heads.filter(F.col("depth") == depth).drop("depth").join(sums, "head").select(
            F.col("head").alias("conv"), "up", "n_convs", "n_children", "n_leaves", (F.col("under") + (F.col("n_convs") - 1) * F.col("last")).alias("saved"), "ends")
        heads = heads or _Depths(done, "summed")
        heads.write(done, depth)
        below = heads.at(depth).select("up", "n_leaves", "saved")
    return resting_nodes.drop("top").unionByName(heads.all())


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def _id_text(rep: dict) -> str:
    return "" if rep["id"] is None else str(rep["id"])


def ends_digests(members: DataFrame) -> DataFrame:
    """rep and ends_sha256: the digest of the ids of each class, ascending and joined by commas.

    Ids are sorted in ranges and joined in lists of ``BLOCK``; the lists of a class then pass one running digest, so a
    class of any size is never held whole.
    """
    conv = members.schema["rep"].dataType
    arrow, name = _arrow(conv), conv.simpleString()

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], arrow), pa.array([r[1] for r in rows], arrow), pa.array([r[2] for r in rows])], ["rep", "first", "list"])

        ready = []
        pairs = (row for batch in batches for row in zip(batch.column("rep").to_pylist(), batch.column("conv").to_pylist()))
        for rep, group in groupby(pairs, key=lambda row: row[0]):
            ids, first = [], None
            for _, one in group:
                first = one if first is None else first
                ids.append(_id_text(one))
                if len(ids) == BLOCK:
                    ready.append((rep, first, ",".join(ids)))
                    ids, first = [], None
            if ids:
                ready.append((rep, first, ",".join(ids)))
            if len(ready) >= 1000:
                yield of(ready)
                ready = []
        if ready:
            yield of(ready)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(batch.column("rep").to_pylist(), batch.column("list").to_pylist()))
        ready = []
        for rep, group in groupby(rows, key=lambda row: row[0]):
            digest, comma = hashlib.sha256(), ""
            for _, ids in group:
                digest.update(f"{comma}{ids}".encode())
                comma = ","
            ready.append((rep, digest.hexdigest()))
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in ready], arrow), pa.array([r[1] for r in ready])], ["rep", "ends_sha256"])

    listed = members.select("rep", "conv").repartitionByRange("rep", "conv").sortWithinPartitions("rep", "conv").mapInArrow(lists, f"rep {name}, first {name}, list string")
    return listed.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(digests, f"rep {name}, ends_sha256 string")


def prefix_trie(turns: DataFrame, ids: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The nodes of the trie of conversations, with the digest of those that end there.

    ``turns`` is as ``numbered`` makes it, ``ids`` has the keys (conv) of all conversations, those without turns, too.
    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (code points that shared turns
    save in the subtree), ends_sha256.
    """
    members = classes(turns, ids)
    nodes = trie_nodes(turns, members, capacity)
    digests = ends_digests(members).withColumnRenamed("rep", "ends")
    return nodes.join(digests, "ends", "left").select(
        F.col("conv.id").alias("conv_id"), "depth", F.col("up.id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
