"""Task results kept as a table: the last result of every task, ready without a shuffle of all attempts.

The table is a base and the changes since, both bucketed and sorted by the keys with one file a bucket. New attempts are
cut to one row a task, dealt to the buckets and merged with the changes; the base isn't touched. Reading joins both bucket
by bucket, in order: neither is shuffled or sorted. When the changes have grown to ``FOLD`` of the base they become part
of a new base. Each state is a version of a snapshot log, so readers see whole states and two writers can't lose rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from ..sources.snapshots import SnapshotLog
from .results import latest_per_task

KEYS = ("run_id", "task_id")
BUCKETS = 200
FOLD = 0.2
# Scans of bucketed tables say that they are sorted only with this setting; files are listed once for it.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class KeptResults:
    """``order`` names the columns that tell which of two results is the later one; it must be total within a task."""

    def __init__(self, spark: SparkSession, path: str, order: Sequence[str], keys: Sequence[str] = KEYS, buckets: int = BUCKETS, fold: float = FOLD):
        self.spark, self.log = spark, SnapshotLog(spark, path)
        self.order, self.keys, self.buckets, self.fold = list(order), list(keys), buckets, fold
        spark.conf.set(ORDERED, "true")

    def add(self, attempts: DataFrame) -> int:
        """Take in new attempts, in any order; returns the version that has them."""
        new = self._write(latest_per_task(attempts, self.order, self.keys))

        def change(state: dict) -> dict:
            self._check(state, new)
            recent = self._write(self._merged(state["recent"], new)) if state.get("recent") else new
            made = {"schema": new["schema"], "buckets": self.buckets, "base": state.get("base"), "recent": recent}
            return self._folded(made) if recent["rows"] >= self.fold * (made["base"] or {"rows": 0})["rows"] else made

        return self.log.update(change)

    def compact(self) -> int:
        """Make the changes part of the base now."""
        return self.log.update(lambda state: self._folded(state) if state.get("recent") else None)

    def read(self) -> DataFrame:
        """The last result of every task."""
        _, state = self.log.latest()
        if not state:
            raise LookupError(f"nothing was kept in {self.log.path} yet")
        parts = [state[p] for p in ("base", "recent") if state.get(p)]
        return self._table(parts[0]) if len(parts) == 1 else self._merged(*parts)

    def forget(self, keep: int = 2) -> list[str]:
        """Drop the files that only older versions than the ``keep`` newest read."""
        return self.log.forget(lambda state: [state[p]["path"] for p in ("base", "recent") if state.get(p)], keep)

    def _check(self, state: dict, new: dict) -> None:
        if state and (state["buckets"] != self.buckets or state["schema"] != new["schema"]):
            raise ValueError(f"{self.log.path} has {state['buckets']} buckets of {state['schema']}, not {self.buckets} of {new['schema']}")

    def _folded(self, state: dict) -> dict:
        base = self._write(self._merged(state["base"], state["recent"])) if state["base"] else state["recent"]
        return state | {"base": base, "recent": None}

    def _write(self, df: DataFrame) -> dict:
        """One sorted file a bucket; what is in the buckets already stays where it is."""
        path, name, seen = self.log.new_folder(), f"kept_{uuid.uuid4().hex}", Observation()
        unkeyed = " or ".join(f"`{k}` is null" for k in self.keys)
        rows = df.repartition(self.buckets, *self.keys).observe(seen, F.count("*").alias("rows"), F.count_if(F.expr(unkeyed)).alias("unkeyed"))
        rows.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", path).saveAsTable(name)
        return {"path": path, "name": name, "schema": df.schema.simpleString(), "fields": df.schema.jsonValue(), **seen.get}

    def _table(self, part: dict) -> DataFrame:
        if not self.spark.catalog.tableExists(part["name"]):  # written by another session
            fields = T.StructType.fromJson(part["fields"]).fields
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
            by = ", ".join(f"`{k}`" for k in self.keys)
            self.spark.sql(f"create table {part['name']} ({columns}) using parquet clustered by ({by}) sorted by ({by}) into {self.buckets} buckets location '{part['path']}'")
        return self.spark.table(part["name"])

    def _merged(self, older: dict, newer: dict) -> DataFrame:
        """The later row of each key, bucket by bucket."""
        a, b = self._table(older), self._table(newer)
        columns = a.columns
        keyed = " and ".join(f"`{k}` is not null" for k in self.keys)
        unkeyed = older["unkeyed"] + newer["unkeyed"]
        left, right = (a.filter(keyed), b.filter(keyed)) if unkeyed else (a, b)
        others = [c for c in columns if c not in self.keys]
        side = lambda df, mark: df.select(*self.keys, F.lit(True).alias(mark), *[F.col(c).alias(f"{mark}_{c}") for c in others])
        at = lambda mark: F.struct(*[F.col(f"{mark}_{c}") for c in self.order])
        joined = side(left, "__a").join(side(right, "__b"), self.keys, "full_outer")
        later = F.col("__a").isNull() | (F.col("__b").isNotNull() & (at("__b") >= at("__a")))
        # column by column, so that a reader of few columns scans few
        merged = joined.select(*[c if c in self.keys else F.when(later, F.col(f"__b_{c}")).otherwise(F.col(f"__a_{c}")).alias(c) for c in columns])
        if not unkeyed:
            return merged
        # rows without a key, of which there are few, find no partner in a join
        apart = a.filter(f"not ({keyed})").unionByName(b.filter(f"not ({keyed})"))
        return merged.unionByName(latest_per_task(apart, self.order, self.keys))
