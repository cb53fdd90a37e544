"""What several operators share: reading tables, written intermediate tables, walks over text batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_dir

# Texts are worked through in runs of about this many characters, so that word lists stay small.
RUN_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return what was written.

    Cuts the lineage like a checkpoint, and keeps columns: later reads take only those they need.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole(text: Column | str) -> Column:
    """The text, an empty one for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def runs(texts: list, most: int = RUN_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts that hold about ``most`` characters together (one text at least)."""
    begin = size = 0
    for at, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield begin, at + 1
            begin, size = at + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def per_text(make: Callable[[], Callable[[list], Iterable]], fields: list[tuple[str, pa.DataType]], carry: tuple[str, ...] = ("doc_id",)):
    """A function for ``mapInArrow`` over frames of ``carry`` columns and ``text``.

    ``make`` runs once in each task and returns a function from a list of texts to one tuple of values a text.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        names = [*carry, *(name for name, _ in fields)]
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for begin, end in runs(texts):
                rows = list(each(texts[begin:end]))
                columns = [pa.array([row[k] for row in rows], kind) for k, (_, kind) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(begin, end - begin) for c in carry), *columns], names)

    return work


class Memory:
    """Results of words seen before, in two generations: when the young one is full it becomes the old one."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def results(self, words: set, compute: Callable[[list], Iterable]) -> dict:
        """A table that has the results of ``words``; ``compute`` makes those that aren't known."""
        missing = words.difference(self.young)
        if len(self.young) + len(missing) > self.most:
            self.old, self.young = self.young, {}
            missing = words
        old = self.old
        again = {word: old[word] for word in missing if word in old}
        self.young.update(again)
        new = list(missing.difference(again))
        if new:
            self.young.update(zip(new, compute(new)))
        return self.young
