"""Keyed state that Spark's streaming aggregations cannot hold: bounded lists and admission counters.

Both helpers first thin out the rows inside every Arrow batch, before the shuffle, so a
key with a third of the stream sends only what can matter to the task that owns it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import PROVIDER, ROCKSDB


def need_rocksdb(df: DataFrame) -> None:
    """State of this kind needs the RocksDB store; the session's setting isn't changed here."""
    if "RocksDB" not in df.sparkSession.conf.get(PROVIDER, ""):
        raise RuntimeError(f"set {PROVIDER} to {ROCKSDB} before starting this query")


def _time_mode(ttl_ms: int | None) -> str:
    """Expiry needs the processing time clock. It also keeps a query running without new
    data, so a query with expiry never ends by itself under an available-now trigger."""
    return "None" if ttl_ms is None else "ProcessingTime"


class NewestRows(StatefulProcessor):
    """Keeps the newest n rows of a key and emits them whenever they change."""

    def __init__(self, schema: StructType, order: Sequence[str], n: int, ttl_ms: int | None):
        self.schema, self.order, self.n, self.ttl_ms = schema, list(order), n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.schema, self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = self.schema.names
        held = [tuple(r) for r in self.rows.get()]
        kept = pd.DataFrame(held, columns=names)
        for batch in rows:
            both = batch[names] if kept.empty else pd.concat([kept, batch[names]], ignore_index=True)
            kept = both.sort_values(self.order, ascending=False, kind="stable").head(self.n)
        self.rows.put([_plain(r) for r in kept.itertuples(index=False, name=None)])
        yield kept.assign(position=range(1, len(kept) + 1)).astype({"position": "int32"})

    def close(self) -> None:
        pass


def _plain(row: tuple) -> tuple:
    return tuple(
        None if v is None or v is pd.NaT or (isinstance(v, float) and v != v)
        else v.to_pydatetime() if isinstance(v, pd.Timestamp)
        else v.item() if hasattr(v, "item") else v
        for v in row
    )


def retain_newest(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, ttl_ms: int | None = None
) -> DataFrame:
    """The newest n rows of every key, emitted again in every batch that changes them."""
    need_rocksdb(stream)
    keys, order, schema = list(keys), list(order), stream.schema

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ordered = batch.sort_values(order, ascending=False, kind="stable")
            yield ordered.groupby(keys, sort=False, dropna=False).head(n)

    out = StructType([*schema.fields, StructField("position", IntegerType())])
    return stream.mapInPandas(thin, schema).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=NewestRows(schema, order, n, ttl_ms), outputStructType=out, outputMode="Update", timeMode=_time_mode(ttl_ms)
    )


class Admission(StatefulProcessor):
    """Admits rows of a key while every clock slot they fall in has room."""

    def __init__(
        self, schema: StructType, order: Sequence[str], second: str, limits: Sequence[tuple[int, int]], ttl_ms: int | None,
        expires: bool = False,
    ):
        self.schema, self.order, self.second = schema, list(order), second
        self.limits, self.ttl_ms, self.expires = list(limits), ttl_ms, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        slot = StructType([StructField("span", LongType()), StructField("slot", LongType())])
        self.used = handle.getMapState("used", slot, StructType([StructField("n", LongType())]), self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        used: dict[tuple[int, int], int] = {}
        admitted = []
        for second in batch[self.second]:
            slots = [(span, int(second) // span) for span, _ in self.limits]
            for slot in slots:
                if slot not in used:
                    used[slot] = self.used.getValue(slot)[0] if self.used.containsKey(slot) else 0
            fits = all(used[slot] < limit for slot, (_, limit) in zip(slots, self.limits))
            if fits:
                for slot in slots:
                    used[slot] += 1
            admitted.append(fits)
        for slot, count in used.items():
            self.used.updateValue(slot, (count,))
        if self.expires:
            # the key's longest slot; once the watermark is past its end no more rows come
            longest = self.limits[-1][0]
            self.handle.registerTimer((int(batch[self.second].iloc[0]) // longest + 1) * longest * 1000)
        yield batch[admitted][self.schema.names]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.used.clear()
        return iter(())

    def close(self) -> None:
        pass


def admit(
    stream: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], limits: Sequence[tuple[int, int]],
    ttl_ms: int | None = None, late: str | None = None,
) -> DataFrame:
    """Rows within the (span seconds, limit) limits, counted per clock slot in arrival order.

    Slots of a longer span contain whole slots of the shorter ones, so rows beyond the
    limit of the shortest span cannot be admitted and are left out before the shuffle.
    The state is keyed by the longest slot too, which spreads a busy key over time.

    With ``late`` (an interval) the state of a slot is dropped by event time, when rows are that much past its end; rows
    that come later than that are left out, so are rows without a time. The query still ends with its data.
    """
    need_rocksdb(stream)
    if late is not None and ttl_ms is not None:
        raise ValueError("state expires by event time (late) or by the clock (ttl_ms), not by both")
    limits = sorted(limits)
    for (short, _), (long, _) in zip(limits, limits[1:]):
        if long % short:
            raise ValueError("every span must be a multiple of the shorter ones")
    keys, order, schema = list(keys), list(order), stream.schema
    (shortest, room), (longest, _) = limits[0], limits[-1]
    second, slot = "clock_second", "clock_slot"
    timed = stream.withColumn(second, F.unix_seconds(at)).withColumn(slot, F.floor(F.col(second) / longest))

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ordered = batch.sort_values(order, kind="stable")
            yield ordered[ordered.groupby([*[ordered[k] for k in keys], ordered[second] // shortest], dropna=False).cumcount() < room]

    thinned = timed.mapInPandas(thin, timed.schema)
    if late is not None:
        thinned = thinned.filter(F.col(at).isNotNull()).withWatermark(at, late)
    return thinned.groupBy(*keys, slot).transformWithStateInPandas(
        statefulProcessor=Admission(schema, order, second, limits, ttl_ms, late is not None), outputStructType=schema, outputMode="Append",
        timeMode=_time_mode(ttl_ms) if late is None else "EventTime",
    )
