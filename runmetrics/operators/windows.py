"""Ordered operators that stay parallel when one key holds most of the rows.

Spark cuts ``row_number() <= n`` to n rows per key *before* the shuffle, as long as n is
below ``spark.sql.optimizer.windowGroupLimitThreshold``. Above it, and for running sums
and trailing counts, the helpers here split the rows of a key over several tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stored

SPLITS = 64
BLOCK_SECONDS = 86_400


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every key in the given total order."""
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    rank = "__rank"
    if n > threshold:
        # Every split keeps its own first n, so a hot key sends at most SPLITS * n rows on.
        split = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if _hashable(df, c)]), F.lit(SPLITS))
        first = Window.partitionBy(*keys, "__split").orderBy(*order)
        df = (
            df.withColumn("__split", split)
            .withColumn(rank, F.row_number().over(first))
            .filter(F.col(rank) <= n)
            .drop(rank, "__split")
        )
    final = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= n).drop(rank)


def _hashable(df: DataFrame, name: str) -> bool:
    return "map<" not in df.schema[name].dataType.simpleString()


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on ``keys`` in which null equals null; the keys of ``left`` stay."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    match = reduce(Column.__and__, [left[k].eqNullSafe(renamed[f"__right_{k}"]) for k in keys]) if keys else F.lit(True)
    return left.join(renamed, match, how).drop(*[f"__right_{k}" for k in keys])


def running_sums(
    points: DataFrame, keys: Sequence[str], order: str, sums: Mapping[str, str], block: Column
) -> DataFrame:
    """Running sums per key along ``order``, in two levels.

    ``sums`` maps a new column to the column it adds up; ``points`` has one row per (key,
    order). ``block`` cuts the order axis into contiguous blocks and must never decrease
    along it. Rows are summed within their block, block totals are summed per key, and the
    two are joined, so no task sees more than one block or the list of block totals.
    """
    keys = list(keys)
    # Both sides of the join below read the points; stored, they are computed once.
    blocked = stored(points.withColumn("__block", block), "points")
    totals = blocked.groupBy(*keys, "__block").agg(*[F.sum(c).alias(f"__total_{out}") for out, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "__block",
        *[F.coalesce(F.sum(f"__total_{out}").over(before), F.lit(0)).alias(f"__offset_{out}") for out in sums],
    )
    within = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.select("*", *[F.sum(c).over(within).alias(f"__within_{out}") for out, c in sums.items()])
    joined = join_null_safe(local.filter("__block is not null"), offsets, [*keys, "__block"]).select(
        *points.columns, *[(F.col(f"__within_{out}") + F.col(f"__offset_{out}")).alias(out) for out in sums]
    )
    # Points without a place on the axis are kept; nothing can be said about their sums.
    placeless = blocked.filter("__block is null").select(*points.columns, *[F.lit(None).cast(joined.schema[out].dataType).alias(out) for out in sums])
    return joined.unionByName(placeless)


def trailing_counts(
    ticks: DataFrame, keys: Sequence[str], second: str, count: str, spans: Sequence[int]
) -> DataFrame:
    """Sums of ``count`` over the last ``span`` seconds, one column ``last_<span>s`` per span.

    ``ticks`` has one row per (keys, second). A count enters the sum at its second and
    leaves it ``span`` seconds later, so every sum is a running sum over entries and
    exits: linear in the ticks, however many of them a span holds.
    """
    keys = list(keys)
    names = [f"in_{span}" for span in spans]
    entry = F.struct(F.col(second).alias("s"), F.lit(True).alias("tick"), *[F.col(count).alias(n) for n in names])
    exits = [
        F.struct(
            (F.col(second) + span).alias("s"), F.lit(False).alias("tick"),
            *[(-F.col(count) if other == span else F.lit(0).cast("long")).alias(n) for other, n in zip(spans, names)],
        )
        for span in spans
    ]
    moves = ticks.select(*keys, F.explode(F.array(entry, *exits)).alias("m")).select(*keys, "m.*")
    points = moves.groupBy(*keys, F.col("s").alias(second)).agg(
        F.bool_or("tick").alias("tick"), *[F.sum(n).alias(n) for n in names]
    )
    sums = {f"last_{span}s": n for span, n in zip(spans, names)}
    summed = running_sums(points, keys, second, sums, F.floor(F.col(second) / BLOCK_SECONDS))
    return summed.filter("tick").select(*keys, second, *sums)
