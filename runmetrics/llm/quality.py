"""Quality rules of documents, and lines that many documents of a host share.

Base rules look at one text: words ``[^\\x20\\x09-\\x0D]+``, lines between ``\\n``. A text fails with fewer than
``LEAST_WORDS`` words or when more than ``REPEATED`` percent of its words are in 5-word windows found twice or more.

Across documents: lines with a word are normalised (lower case, digits as 0, one space for white space) and hashed
together with their host. A line is over the limit when at least ``LEAST_DOCUMENTS`` different documents of its host
hold it and these are more than ``SHARE`` percent of the host's different documents. Such lines are removed; a document
left with fewer than ``LEAST_WORDS`` words or less than ``LEFT`` percent of its words is depleted and rejected. Documents
are different when their texts are: copies of a text count once, else a group of copies would deplete itself.

Column functions only. Window repeats are found by 64-bit hashes and confirmed on the words; lines are told apart by a
64-bit hash. Null texts have no words and fail. A null host is a host like any other. Each row of a repeated id is
judged by itself. An empty table gives no rows; other columns take no part. Texts are worked through whole, in arrays of
their words and lines, so the longest text bounds a task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import whole, written
from .pii import let

LEAST_WORDS, REPEATED, WINDOW = 10, 20, 5
LEAST_DOCUMENTS, SHARE, LEFT = 8, 5, 50
_WORD, _BLANKS = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def word_lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(_WORD))


def normalised(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(line, _BLANKS, " ")), "[0-9]", "0"))


def line_key(host: Column, line: Column) -> Column:
    return F.xxhash64(host, normalised(line))


def _twice(keyed: Column) -> Column:
    """The places (``at``) of an array of (key, at) whose key occurs twice or more."""
    def again(ordered: Column) -> Column:
        same = lambda x, at: F.coalesce(F.get(ordered, at)["key"] == x["key"], F.lit(False))
        return F.transform(F.filter(ordered, lambda x, at: same(x, at - 1) | same(x, at + 1)), lambda x: x["at"])

    return let(F.sort_array(keyed), again)


def repeat_words(words_of: Column, window: int = WINDOW) -> Column:
    """How many words of an array are in windows that occur twice or more."""
    return let(words_of, lambda found: _repeat_words(found, window))


def _repeat_words(found: Column, window: int) -> Column:
    def at(place: Column) -> list[Column]:
        return [F.get(found, place + k) for k in range(window)]

    def covered(places: Column) -> Column:
        reach = F.transform(places, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1) - p, F.lit(window))))
        return F.aggregate(reach, F.lit(0), lambda a, b: a + b)

    def count(hashes: Column) -> Column:
        candidates = _twice(F.transform(hashes, lambda h, k: F.struct(h.alias("key"), k.alias("at"))))
        exact = _twice(F.transform(candidates, lambda p: F.struct(F.array(*at(p)).alias("key"), p.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(F.sort_array(exact), covered))

    hashes = F.transform(F.sequence(F.lit(0), F.size(found) - window), lambda p: F.xxhash64(*at(p)))
    return F.when(F.size(found) <= window, 0).otherwise(let(hashes, count)).cast("long")


def line_facts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """One row a document, written: row, doc_id, host, copy (a hash of the text), lines (key, words) and the base counts."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), F.col(host_column).alias("host"), whole(text_column).alias("text"))
    counted = let(words(F.col("text")), lambda found: F.struct(F.size(found).cast("long").alias("n_words"), repeat_words(found).alias("n_repeat_words")))
    lined = let(word_lines(F.col("text")), lambda of: F.struct(
        (F.size(of) - F.size(F.array_distinct(of))).cast("long").alias("n_dup_lines"),
        F.transform(of, lambda line: F.struct(line_key(F.col("host"), line).alias("line"), F.size(words(line)).cast("long").alias("n"))).alias("lines")))
    facts = source.select(
        "row", "doc_id", "host", F.xxhash64("text").alias("copy"), counted.alias("counted"), lined.alias("lined"),
        F.length(F.regexp_replace("text", _BLANKS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    return written(facts.select("row", "doc_id", "host", "copy", "word_chars", "n_symbols", "counted.*", "lined.*"), "line-facts")


def frequent_lines(facts: DataFrame, least: int = LEAST_DOCUMENTS, share: int = SHARE) -> DataFrame:
    """Lines over the limit: line, documents, of (the different documents of the host)."""
    hosts = facts.groupBy("host").agg(F.count_distinct("copy").alias("of"))
    each = facts.select("host", "copy", F.explode(F.array_distinct(F.transform("lines", lambda line: line["line"]))).alias("line"))
    shared = each.groupBy("line").agg(F.min("host").alias("host"), F.count_distinct("copy").alias("documents")).filter(F.col("documents") >= least)
    of_host = shared.join(hosts, shared["host"].eqNullSafe(hosts["host"]))
    return of_host.filter(F.col("documents") * 100 > F.col("of") * share).select("line", "documents", "of")


def quality_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """One row a document: doc_id, the base counts, base_failed, kept, n_removed_words and removed (keys of its lines over the limit)."""
    facts = line_facts(docs, id_column, text_column, host_column)
    over = written(frequent_lines(facts), "lines").select("line")
    held = facts.select("row", F.explode("lines").alias("l")).select("row", "l.line", "l.n")
    removed = held.groupBy("row", "line").agg(F.sum("n").alias("n")).join(over, "line").groupBy("row").agg(
        F.sum("n").alias("gone"), F.sort_array(F.collect_list("line")).alias("removed"))
    judged = facts.drop("lines", "copy", "host").join(removed, "row", "left").withColumn("gone", F.coalesce("gone", F.lit(0).cast("long")))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED)
    left = F.col("n_words") - F.col("gone")
    depleted = (left < LEAST_WORDS) | (left * 100 < F.col("n_words") * LEFT)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
        F.col("gone").alias("n_removed_words"), F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"))


def without_lines(text: Column, host: Column, removed: Column) -> Column:
    """The text without the lines whose keys are in ``removed``."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.array_contains(removed, line_key(host, line))), "\n")


def clean(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """The documents that pass, all their columns, without the lines over their host's limit.

    Rows get an id of their own, so that rows of one id keep apart; they are written, for the id to be the same at each read.
    """
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    judged = quality_rules(rows, "__row", text_column, host_column).filter("kept").select(F.col("doc_id").alias("__row"), F.col("removed").alias("__removed"))
    kept = rows.join(judged, "__row")
    text = F.when(F.size("__removed") > 0, without_lines(F.col(f"`{text_column}`"), F.col(f"`{host_column}`"), F.col("__removed"))).otherwise(F.col(f"`{text_column}`"))
    return kept.select(*(text.alias(n) if n == text_column else F.col(f"`{n}`") for n in docs.columns))
