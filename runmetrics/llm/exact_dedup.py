"""Exact duplicates by an extendible-hash index on shared files.

Every document is an entry (hash, id, length, digest) in an index table in the shared folder. A directory over the
leading bits of the hash is doubled until no bucket holds more than ``capacity`` different hashes. Owner tasks take
ranges of buckets, so each hash has one owner. Documents that share a hash have their bytes compared: the different
texts of a hash form a chain, and a class is one (hash, place in the chain).

Texts are equal when identical after all characters of ``[\\x20\\x09-\\x0D]`` are deleted. Null counts as empty, so
null, empty and blank texts are one class. Of a class the row with the most code points in its original text stays,
then the smallest doc_id (null ids last); of rows that repeat an id and a length, the first in the index stays.
An empty table gives no rows. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import whole, written

CAPACITY = 4096
# 256 pages of 32768 bits: the prefilter of texts to compare is at most 1 MB, whatever the input.
PAGES, PAGE_BITS = 256, 32768
# Parts into which the entries of one hash are summed up before they meet.
SALTS = 64
HASH_BITS = 64


def normalised(text: Column | str) -> Column:
    return F.regexp_replace(whole(text), r"[\x20\x09-\x0D]+", "")


def prefix(h: Column | str, depth: int) -> Column:
    """The leading ``depth`` bits of a 64-bit hash."""
    h = F.col(h) if isinstance(h, str) else h
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(h, HASH_BITS - depth)


def entries(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The index rows: row_id, doc_id, h, n_chars, text_sha256."""
    text = docs.select(
        F.col(id_column).alias("doc_id"), F.length(whole(text_column)).cast("long").alias("n_chars"), normalised(text_column).alias("norm"))
    return text.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", F.xxhash64("norm").alias("h"), "n_chars",
        F.sha2("norm", 256).alias("text_sha256"))


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, list[int]]:
    """The buckets over distinct hashes ``h``, as (depth, slot, bucket), and the depths that occur.

    Starts with as many slots as the number of hashes asks for and doubles while a bucket is overfull, so a bucket's
    depth is the number of leading bits that its hashes share, its slot these bits, and ``bucket`` their place in the
    order of hashes. Slots that point to the same bucket are one row: the table grows with the buckets alone.
    """
    total = keys.count()
    depth = max(0, math.ceil(math.log2(max(1, 2 * total / capacity))))
    depths, buckets, rest = [], None, keys.select("h")
    while True:
        sizes = written(rest.groupBy(prefix("h", depth).alias("slot")).agg(F.count("*").alias("n")), "directory")
        last = depth >= HASH_BITS - 2
        full = sizes if last else sizes.filter(F.col("n") <= capacity)
        level = full.select(F.lit(depth).alias("depth"), "slot", F.shiftleft("slot", HASH_BITS - 1 - depth).alias("bucket"))
        buckets = level if buckets is None else buckets.unionByName(level)
        depths.append(depth)
        overfull = sizes.filter(F.col("n") > capacity)
        if last or overfull.isEmpty():
            return buckets, depths
        rest = rest.withColumn("slot", prefix("h", depth)).join(overfull.select("slot"), "slot", "left_semi").select("h")
        depth += 1


def owned(rows: DataFrame, buckets: DataFrame, depths: list[int]) -> DataFrame:
    """``rows`` (with ``h``) and the bucket of each: looked up under its leading bits at every depth, found at one."""
    places = F.array(*(F.struct(F.lit(d).alias("depth"), prefix("h", d).alias("slot")) for d in depths))
    looked = rows.withColumn("place", F.explode(places)).withColumns({"depth": F.col("place.depth"), "slot": F.col("place.slot")})
    return looked.join(buckets, ["depth", "slot"]).drop("place", "depth", "slot")


def _bit(h: Column) -> tuple[Column, Column]:
    return F.pmod(h, F.lit(PAGES)), F.pmod(F.shiftrightunsigned(h, 16), F.lit(PAGE_BITS))


def chains(docs: DataFrame, shared: DataFrame, text_column: str = "text") -> DataFrame:
    """Compare the bytes of all texts under the hashes ``shared`` (h): (h, text_sha256, chain) of hashes with several texts.

    A bitmap of those hashes, of a fixed size, keeps most other texts out of the shuffle; the join behind it is exact.
    Equal texts collapse before they are shuffled, so that a large group of copies moves once a task.
    """
    page, bit = _bit(F.col("h"))
    pages = shared.select(page.alias("page"), bit.alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    text = docs.select(normalised(text_column).alias("norm")).withColumn("h", F.xxhash64("norm"))
    page, bit = _bit(F.col("h"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("long")
    listed = (text.withColumns({"page": page, "bit": bit}).join(F.broadcast(pages), "page")
              .filter(byte.bitwiseAND(F.expr("shiftleft(1L, cast(bit % 8 as int))")) != 0).select("h", "norm"))
    different = listed.distinct().join(shared.select("h"), "h", "left_semi")
    collided = different.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    order = Window.partitionBy("h").orderBy("norm")
    chain = different.join(collided, "h", "left_semi").select("h", F.sha2("norm", 256).alias("text_sha256"), (F.row_number().over(order) - 1).alias("chain"))
    return chain


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256, and the bucket that owns it."""
    index = written(entries(docs, id_column, text_column), "index")
    hashes = written(index.groupBy("h").agg(F.count("*").alias("n")), "hashes")
    buckets, depths = directory(hashes, capacity)
    chained = written(chains(docs, hashes.filter("n > 1"), text_column), "chains")
    best = F.min(F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("without_id"), "doc_id", "row_id"))
    members = index.join(chained, ["h", "text_sha256"], "left").withColumn("chain", F.coalesce("chain", F.lit(0)))
    summed = (members.groupBy("h", "chain", F.pmod("row_id", F.lit(SALTS)).alias("salt"))
              .agg(best.alias("best"), F.count("*").alias("n")))
    classes = owned(summed, buckets, depths).repartitionByRange("bucket", "h").groupBy("bucket", "h", "chain").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    return members.join(classes, ["h", "chain"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("best.row_id")).alias("kept"),
        "text_sha256", "bucket")


def keep_first(docs: DataFrame, kept: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is in ``kept`` (doc_id), one row for each row of ``kept``.

    Null ids match null. Of rows that repeat an id as many stay as ``kept`` has, those of the longest texts first.
    """
    wanted = kept.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n"))
    # ids for which it isn't enough to look the id up
    several = written(docs.groupBy(F.col(id_column).alias("__id")).agg(F.count("*").alias("__rows")).filter("__rows > 1 or __id is null").select("__id"), "repeated")
    once = docs.join(wanted.select("__id"), docs[id_column] == F.col("__id"), "left_semi")
    if several.isEmpty():
        return once
    order = Window.partitionBy("__id").orderBy(F.length(whole(text_column)).desc(), F.col(text_column))
    repeated = docs.join(several.join(wanted, several["__id"].eqNullSafe(wanted["__id"])).select(wanted["__id"], "__n"), docs[id_column].eqNullSafe(F.col("__id")))
    names = [F.col(f"`{n}`") for n in docs.columns]
    first = repeated.withColumn("__at", F.row_number().over(order)).filter("__at <= __n").select(*names)
    return once.join(several, docs[id_column] == several["__id"], "left_anti").unionByName(first)


def keep_rows(docs: DataFrame, choose: Callable[[DataFrame, str], DataFrame], id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``choose`` names: of a frame and its id column it gives the ids to keep (doc_id).

    Where ids are null or repeated, rows get an id of their own, (without id, id, number), in the order of the ids with
    null ones last. It is written, so that a row has the same number wherever it is read.
    """
    ids = docs.groupBy(F.col(id_column).alias("__id")).agg(F.count("*").alias("__rows"))
    if ids.filter("__rows > 1 or __id is null").isEmpty():
        return docs.join(choose(docs, id_column).select(F.col("doc_id").alias("__id")), docs[id_column] == F.col("__id"), "left_semi")
    own = F.struct(F.col(id_column).isNull().alias("without_id"), F.col(id_column).alias("id"), F.monotonically_increasing_id().alias("number"))
    rows = written(docs.withColumn("__row", own), "rows")
    wanted = choose(rows, "__row").select(F.col("doc_id.number").alias("__number"))
    return rows.join(wanted, rows["__row"]["number"] == F.col("__number"), "left_semi").select(*(F.col(f"`{n}`") for n in docs.columns))
