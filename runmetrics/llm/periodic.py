"""Periodic runs of words, found by recursive frequency splitting and a lag scan of what survives.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least ``LEAST_WORDS``
words and ``LEAST_PERIODS`` periods long, that no neighbouring word extends. Each word of a run occurs at least
``LEAST_PERIODS`` times in it, so a word that occurs fewer times within its segment is in no run there and splits it.
The parts are segments of their own, those under ``LEAST_WORDS`` words go, and words are counted anew in segments that
changed, until none does. All segments of a batch of texts are split together.

Surviving segments are scanned at lags between m/2 and m for m = 1, 2, 4, ...: the lag of a place is the distance to the
next place where the same m words stand. Inside a run of such a period that distance is the period itself at every
place, so places in a row with one lag are one run. Windows of 2m words are numbered by the pairs of windows of m, and
the scan ends when no window recurs: n words take n log² n steps at most, however repetitive they are.

Words are ``[^\\x20\\x09-\\x0D]+``. Null, empty and blank texts have no words and no runs, an empty table gives no rows.
Each row of a repeated id gets a row. A text is worked through whole, so the longest text bounds a task's memory. Other
columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import per_text

LEAST_WORDS = 24
# Three at least: a shorter run may hold no two whole windows of its period.
LEAST_PERIODS = 3


def split_segments(words: np.ndarray, segment: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int]]:
    """Begin and end of the segments in which every word occurs ``times`` times or more, of at least ``least`` words.

    ``words`` are word numbers, ``segment`` the number of the text of each, in order.
    """
    place, size = np.arange(len(words)), int(words.max(initial=0)) + 1
    while len(place):
        _, which, count = np.unique(segment * size + words[place], return_inverse=True, return_counts=True)
        frequent = count[which] >= times
        changed = np.zeros(segment[-1] + 1, bool)
        changed[segment[~frequent]] = True
        stable = ~changed[segment]
        if stable.any():
            own, at = place[stable], segment[stable]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            last = np.r_[first[1:], len(at)] - 1
            yield from ((a, b + 1) for a, b in zip(own[first].tolist(), own[last].tolist()) if b - a >= least - 1)
        open_ = frequent & ~stable
        place, segment = place[open_], segment[open_]
        if len(place):
            begins = np.r_[True, (place[1:] != place[:-1] + 1) | (segment[1:] != segment[:-1])]
            number = np.cumsum(begins) - 1
            place, number = (x[np.bincount(number)[number] >= least] for x in (place, number))
            segment = np.cumsum(np.r_[True, number[1:] != number[:-1]]) - 1 if len(number) else number


def scan_lags(words: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of one segment."""
    found, windows, m = [], words, 1
    while times * (m // 2 + 1) <= len(words):
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        if not same.any():
            break
        lag = np.zeros(len(windows) + 2, np.int64)
        lag[order[:-1][same] + 1] = (order[1:] - order[:-1])[same]
        lag[(lag <= m // 2) | (lag > m)] = 0
        turns = np.flatnonzero(np.diff(lag))
        begin, end, period = turns[:-1], turns[1:], lag[turns[:-1] + 1]
        length = end - begin - 1 + m + period
        good = (period > 0) & (length >= np.maximum(least, times * period))
        found += zip(begin[good].tolist(), length[good].tolist(), period[good].tolist())
        if 2 * m > len(words):
            break
        _, windows = np.unique(windows[:-m] * (len(words) + 1) + windows[m:], return_inverse=True)
        m *= 2
    return found


def scan(texts: list[str], least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> list[tuple[list, str]]:
    """For each text its runs, by start and period, and the text without the repeats: of each run the first period stays."""
    split = [text.encode().split() for text in texts]  # bytes are split at exactly the six blanks
    sizes = [len(words) for words in split]
    numbers = {}
    ids = np.fromiter((numbers.setdefault(word, len(numbers)) for words in split for word in words), np.int64, sum(sizes))
    owner = np.repeat(np.arange(len(split)), sizes)
    first = np.cumsum([0, *sizes])
    runs = [[] for _ in texts]
    for begin, end in split_segments(ids, owner, least, times):
        _, segment = np.unique(ids[begin:end], return_inverse=True)
        text = int(owner[begin])
        offset = begin - int(first[text])
        runs[text] += [(offset + start, length, period) for start, length, period in scan_lags(segment, least, times)]
    made = []
    for words, of in zip(split, runs):
        of.sort(key=lambda run: (run[0], run[2]))
        if of:
            covered = np.zeros(len(words) + 1, np.int64)
            for start, length, period in of:
                covered[start + period] += 1
                covered[start + length] -= 1
            words = [words[at] for at in np.flatnonzero(np.cumsum(covered)[:-1] == 0).tolist()]
        made.append((of, b" ".join(words).decode()))
    return made


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> DataFrame:
    """doc_id, runs (an array of start, length, period) and collapsed (the text without repeats) of every document."""
    if times < LEAST_PERIODS:
        raise ValueError(f"runs of fewer than {LEAST_PERIODS} periods can't be found")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    work = per_text(lambda: lambda texts: scan(texts, least, times), [("runs", kind), ("collapsed", pa.string())])
    return source.mapInArrow(work, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of greatest length for its period, of equal ones the first; null without runs."""
    def better(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
